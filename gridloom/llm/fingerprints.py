"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct 48-bit hashes of a text's runs of
``width`` words (words ``[^\\x20\\x09-\\x0D]+``, case kept); a text with fewer words has its whole
sequence as its one shingle.  Sketches of parts merge into the sketch of the whole, and two of
them estimate resemblance, containment and the number of distinct shingles.  Everything is
column expressions: no Python touches a row.

Keys are numbers.  Defined results: a null or empty text, or one of spaces only, has the empty sketch.  Two empty
sketches resemble each other fully (1), an empty and a filled one not at all (0).  Sketches with
fewer than ``k`` hashes are the whole shingle set, so their figures are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.llm.registry import query, table
from gridloom.session import broadcast_if_small, stage

K = 128
WIDTH = 5
BITS = 48
RANGE_ROWS = 4096
RANGES = 1024
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Array of the 48-bit hashes of all runs of ``width`` words, repeats included."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(width))), 64 - BITS),
        )
        few = F.array(F.shiftrightunsigned(F.xxhash64(h, n), 64 - BITS))
        none = F.array().cast("array<bigint>")
        return F.when(n >= width, many).when(n > 0, few).otherwise(none)

    # The words are hashed once: a one-element array binds them to a name.
    return F.flatten(F.transform(F.array(words), runs))


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return bottom(shingle_hashes(F.coalesce(text.cast("string"), F.lit("")), width), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return bottom(F.concat(a, b), k)


def merge_groups(sketches: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch per group of ``keys``.

    The k smallest of a group are found in two steps, salted by hash, so that a group may hold
    any number of sketches; at most k hashes per salt reach the last step.
    """
    names = [f"`{c}`" for c in keys]
    hashes = sketches.select(*names, F.explode(value).alias("_h")).groupBy(*names, "_h").agg(F.lit(1).alias("_1")).drop("_1")
    salted = hashes.withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(64)))
    best = Window.partitionBy(*names, "_s").orderBy("_h")
    salted = salted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return salted.groupBy(*names).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(value))


def distinct_estimate(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) / the k-th hash as a share of the range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / F.element_at(a, -1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom k that both hold."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    common = resemblance(a, b, k) * distinct_estimate(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_estimate(a, k)))


def encode(a: Column) -> Column:
    """Text form: 12 hex digits per hash, ascending."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


def decode(text: Column) -> Column:
    n = BITS // 4
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.length(text) / n).cast("int") - 1), lambda i: F.conv(F.substring(text, i * n + 1, n), 16, 10).cast("bigint"))
    )


def in_ranges(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """``rows`` with (range, slot, part): stretches of ascending (``key``, ``tie``) of about RANGE_ROWS rows.

    Keys are cut at quantiles, and each stretch between two of them evenly.  Null keys are the first
    range.  A key that many rows have is a quantile, so the rows at a cut, and those without a key, are
    counted and cut again by ``tie``, a 64-bit hash: these slots come before the rest of the range.
    Rows with the same key and tie stay together.  Only the cuts (at most RANGES) come to the driver.
    """
    if dict(rows.dtypes)[key].split("(")[0] not in NUMBERS:
        raise ValueError(f"{key} must be a number to be cut into ranges")
    marks = [i / RANGES for i in range(RANGES)]
    facts = rows.agg(F.count("*").alias("n"), F.max(key).alias("top"), F.percentile_approx(key, marks, 10 * RANGES).alias("cuts")).first()
    wanted = max(1, min(RANGES, facts["n"] // RANGE_ROWS))
    cuts = sorted({facts["cuts"][i * RANGES // wanted] for i in range(wanted)}) if facts["cuts"] else []
    finer = max(1, facts["n"] // (RANGE_ROWS * wanted))
    at_cut = F.col(key).isNull() | F.col(key).isin(cuts)
    often = {r[0]: r[1] // RANGE_ROWS + 1 for r in rows.where(at_cut).groupBy(key).agg(F.count("*")).toLocalIterator()}
    # Range 0 holds the rows without a key, range i those from the i-th cut on.
    bounds = F.array(*(F.lit(c) for c in cuts)).cast(f"array<{dict(rows.dtypes)[key]}>")
    out = rows.withColumn("range", F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(key)))))
    slots = F.get(F.array(*(F.lit(often.get(c, 1)) for c in [None, *cuts])), F.col("range"))
    start, nth = F.get(bounds, F.col("range") - 1), F.col("range") - 1
    # 2^64 ties in equal stretches, lowest first.
    slot = F.least(slots - 1, F.floor((F.col(tie).cast("double") / 2.0**64 + 0.5) * slots))
    out = out.withColumn("slot", F.when(F.coalesce(F.col(key) == start, F.lit(True)), slot).otherwise(slots).cast("long"))
    span = F.array(*(F.lit(float(b - a + 1)) for a, b in zip(cuts, [*cuts[1:], facts["top"]], strict=False))).cast("array<double>")
    within = F.floor((F.col(key) - start) / F.get(span, nth) * finer)
    part = F.when(F.col("slot") == slots, F.least(within, F.lit(finer - 1)))
    return out.withColumn("part", F.coalesce(part, F.lit(0)).cast("long"))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, width: int = WIDTH) -> DataFrame:
    """(key, text, sketch, next_text, next_sketch): each row and the one that follows by ascending key.

    The first row follows the last one.  The texts are shuffled once, into ranges of keys; inside
    a range the neighbour is the next row.  The last row of a range has its neighbour at the head
    of the next range: these heads, one per range, are looked up and joined by range.  Null keys
    come first; rows with the same key are in the order of their texts' hashes.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = in_ranges(rows.withColumn("tie", F.xxhash64("text")), "key", "tie")
    heads = rows.groupBy("range", "slot", "part").agg(F.min(F.struct("key", "tie")).alias("head"))
    line = Window.orderBy("range", "slot", "part")
    around = Window.orderBy("range", "slot", "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = stage(
        heads.select("range", "slot", "part", F.coalesce(F.lead("head").over(line), F.first("head").over(around)).alias("head")), "heads"
    )
    wanted = broadcast_if_small(heads.select(F.col("head.key").alias("k"), F.col("head.tie").alias("t"), F.col("range").alias("r"), F.col("slot").alias("s"), F.col("part").alias("p")), heads.count())
    border = rows.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")))
    border = border.groupBy("r", "s", "p").agg(F.first("text").alias("border_text"))
    border = border.withColumn("border_sketch", sketch(F.col("border_text"), k, width))
    here = Window.partitionBy("range", "slot", "part").orderBy(F.col("key").asc_nulls_first(), "tie")
    out = rows.withColumn("next_text", F.lead("text").over(here)).withColumn("sketch", sketch(F.col("text"), k, width))
    out = out.withColumn("next_sketch", F.lead("sketch").over(here))
    out = out.join(border, (F.col("range") == F.col("r")) & (F.col("slot") == F.col("s")) & (F.col("part") == F.col("p")), "left")
    last = F.col("next_text").isNull()
    return out.select(
        "key", "text", "sketch",
        F.when(last, F.col("border_text")).otherwise(F.col("next_text")).alias("next_text"),
        F.when(last, F.col("border_sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"),
    )


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, width: int = WIDTH) -> DataFrame:
    """(key, distinct_shingles, sketch) for each row."""
    own = sketch(F.col(f"`{text}`"), k, width)
    out = docs.select(F.col(f"`{key}`").alias("key"), own.alias("sketch"))
    return out.select("key", distinct_estimate(F.col("sketch"), k).alias("distinct_shingles"), "sketch")


@query("op5_fingerprints")
def edited_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = rows.select(
        "key", "sketch", "next_sketch", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    out = out.withColumn("edited_sketch", sketch(F.col("edited")))
    return out.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
