"""Mixing sources to target weights by systematic sampling.

Every source gets a target, a share of all words by weight; a target stops at ``max_repeats``
times the source's size and the excess goes to the others by weight, until none is above.  A
document of a source is expected target / source size times.  Within its source the documents
are put in order, their expected copies are summed up from the front, one random offset is
added, and a document is emitted once for each whole number its stretch of the sum crosses.

The order is by size class, then by size: neighbours are alike, so a source's words come near
its target.  Long documents go first: the few that hold a twentieth of their source, then those
that hold a 400th, then the rest, each level sharing the words that the levels before it left,
so that the rest makes up for the rounding of the long ones.  The sum is taken in buckets of a few thousand documents and shifted by the totals
of the buckets before, so no task holds a source.  It is kept in whole numbers of 2^-24 copies:
the same on every run and in any order of addition.

Defined results: a null or empty text has size 0; the empty documents of a source with words are
sampled like the others and take no words.  A source without words has target 0 and gives no
copies.  A null source is a source, last in order.  Rows that repeat every sampled column are
interchangeable.  No rows in, no rows out.  Other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.llm.registry import query, table
from gridloom.llm.rows import row_hash
from gridloom.session import stage

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BUCKET_ROWS = 8192
UNIT = 1 << 24
LEVELS = (20, 400)
WORD = r"[^\x20\x09-\x0D]+"
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``weight`` and ``target``; one row per source.

    Sources are filled in the order in which they would reach their limit: those below the
    level that the rest can share equally by weight are full.
    """
    listed = F.array(*(F.lit(int(w)) for w in weights))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = F.col("source_size") * max_repeats
    filling = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    out = sources.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("level", level).withColumn("full", limit / F.col("weight") <= F.col("level"))
    # Beyond the first source that is not full, all share the level found there.
    shared = F.min(F.when(~F.col("full"), F.struct(limit / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    out = out.withColumn("shared", shared["level"])
    return out.withColumn("target", F.when(F.col("full"), limit.cast("double")).otherwise(F.col("weight") * F.col("shared"))).drop(
        "level", "full", "shared"
    )


def _copies(rows: DataFrame, goals: DataFrame, max_repeats: int, seed: int) -> DataFrame:
    """``rows`` with ``copies``: one systematic draw per source, of ``left`` words out of ``of_words``."""
    rate = F.least(F.lit(float(max_repeats)), F.greatest(F.lit(0.0), F.col("left") / F.col("of_words")))
    goals = goals.select(F.col("source").alias("of"), F.when(F.col("of_words") > 0, F.floor(rate * UNIT)).otherwise(0).cast("long").alias("each"))
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    buckets = rows.groupBy("source", "klass", "part").agg(F.sum("each").alias("total"))
    ahead = Window.partitionBy("source").orderBy("klass", "part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("source").alias("of"), F.col("klass").alias("k"), F.col("part").alias("p"),
        F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"),
    )
    at = Window.partitionBy("source", "klass", "part").orderBy("size", "draw", "key")
    summed = F.sum("each").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto", summed).join(
        buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("klass") == F.col("k")) & (F.col("part") == F.col("p"))
    )
    seeded = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit(""))).cast("binary"))
    end = F.col("ahead") + F.col("upto") + F.conv(F.substring(seeded, 1, 6), 16, 10).cast("long")
    copies = F.shiftright(end, 24) - F.shiftright(end - F.col("each"), 24)
    return rows.select("key", "digest", "source", "size", copies.cast("long").alias("copies"))


def sample(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """(key, digest, source, size, source_size, target, copies), one row per row of ``docs``."""
    sized = stage(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{source}`").cast("string").alias("source"),
            word_count(F.col(f"`{text}`").cast("string")).alias("size"),
            F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")).alias("digest"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    goals = stage(targets(totals, weights, max_repeats), "targets")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("digest")).cast("binary"))
    # Eighths of a power of two, each cut by draw into parts of about BUCKET_ROWS rows at most.
    klass = F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8).cast("int")
    parts = F.ceil(F.col("source_rows") / F.lit(float(BUCKET_ROWS)))
    part = F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * parts / F.lit(float(1 << 32))).cast("long")
    level = sum((F.col("size") * n < F.col("source_size")).cast("int") for n in LEVELS)
    facts = goals.select(F.col("source").alias("of"), "source_size", "source_rows")
    rows = sized.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("draw", draw)
    rows = stage(rows.withColumn("klass", klass).withColumn("part", part).withColumn("level", level).drop("source_rows", "source_size"), "ordered")
    left = goals.select("source", F.col("target").alias("left"), F.col("source_size").alias("of_words"))
    drawn = []
    for n in range(len(LEVELS) + 1):
        drawn.append(stage(_copies(rows.where(F.col("level") == n).drop("level"), left, max_repeats, seed), "drawn"))
        done = drawn[-1].groupBy(F.col("source").alias("of")).agg(F.sum(F.col("copies") * F.col("size")).alias("took"), F.sum("size").alias("had"))
        left = left.join(done, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source",
            (F.col("left") - F.coalesce("took", F.lit(0))).alias("left"),
            (F.col("of_words") - F.coalesce("had", F.lit(0))).alias("of_words"),
        )
    out = drawn[0]
    for more in drawn[1:]:
        out = out.union(more)
    goals = goals.select(F.col("source").alias("of"), "source_size", "target")
    return out.join(goals, F.col("source").eqNullSafe(F.col("of"))).select("key", "digest", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with all their columns."""
    chosen = sample(docs, text, source, key, **how).where("copies > 0")
    # Rows with the same key, source and text are told apart by nothing: their copies are shared out among them.
    chosen = chosen.groupBy(_name(F.col("key"), F.col("source"), F.col("digest")).alias("of")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    digest = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))
    name = _name(F.col(f"`{key}`"), F.col(f"`{source}`").cast("string"), digest)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), name.alias("name"), row_hash(docs).alias("tie"))
    taken = held.join(chosen, F.col("name") == F.col("of"))
    if not chosen.where("rows > 1").isEmpty():
        taken = taken.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("tie")))
    else:
        taken = taken.withColumn("place", F.lit(1))
    again = F.floor(F.col("copies") / F.col("rows")) + (F.col("place") <= F.col("copies") % F.col("rows")).cast("long")
    taken = taken.withColumn("again", again.cast("int")).where("again > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("again"))).alias("copy")).select("row.*")


def _name(key: Column, source: Column, digest: Column) -> Column:
    parts = (F.coalesce(key.cast("string"), F.lit("?")), F.coalesce(source, F.lit("")), source.isNull().cast("string"), digest)
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


_LEVELS_SQL = ",\n".join(
    f"""e{n} AS (SELECT *, (upto >> 24) - ((upto - each) >> 24) AS copies FROM (
        SELECT *, CAST(sum(each) OVER (PARTITION BY source ORDER BY klass, part, size, draw, doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
               + CAST('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 6) AS BIGINT) AS upto FROM (
          SELECT o.*, CASE WHEN of_words > 0 THEN CAST(floor(least(3e0, greatest(0e0, words / of_words)) * {UNIT}) AS BIGINT) ELSE 0 END AS each
          FROM o JOIN g{n} g ON o.source IS NOT DISTINCT FROM g.source WHERE level = {n}))),
    g{n + 1} AS (SELECT g.source, words - coalesce(took, 0) AS words, of_words - coalesce(had, 0) AS of_words
       FROM g{n} g LEFT JOIN (SELECT source, CAST(sum(copies * size) AS DOUBLE) AS took, CAST(sum(size) AS BIGINT) AS had FROM e{n} GROUP BY source) t
         ON g.source IS NOT DISTINCT FROM t.source)"""
    for n in range(len(LEVELS) + 1)
)

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(text, '')) AS digest FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM d GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY 3e0 * source_size / weight, encode(source) NULLS LAST) AS i FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                  - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                 / CAST(sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2),
s4 AS (SELECT *, 3e0 * source_size / weight <= level AS is_full FROM s3),
s5 AS (SELECT source, source_size, source_rows,
              CASE WHEN is_full THEN 3e0 * source_size
                   ELSE weight * (SELECT arg_min(level, i) FROM s4 WHERE NOT is_full) END AS target FROM s4),
r AS (SELECT d.*, s.source_size, s.source_rows, s.target,
             md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest) AS draw
      FROM d JOIN s5 s ON d.source IS NOT DISTINCT FROM s.source),
o AS (SELECT *, floor(log2(size + 1e0) * 8) AS klass,
             floor(CAST('0x' || substr(draw, 1, 8) AS BIGINT) * ceil(source_rows / {BUCKET_ROWS}e0) / 4294967296e0) AS part,
             {" + ".join(f"CAST(size * {n} < source_size AS INT)" for n in LEVELS)} AS level FROM r),
g0 AS (SELECT source, target AS words, source_size AS of_words FROM s5),
{_LEVELS_SQL}
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM
({" UNION ALL ".join(f"SELECT * FROM e{n}" for n in range(len(LEVELS) + 1))})"""


@query("op1_mixing", OP1_SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
