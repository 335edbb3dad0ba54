"""Exact dedup by skew-safe combining: local, then salted groups, then the winners of the salts.

Every stage groups by the whole text as well as its digest, so two texts with one digest would
stay apart.  Equal texts first meet inside their task (partial aggregation), then in one of
``salts`` groups chosen by the row, and only the winner of each salted group goes on; a text
that makes up a third of all rows reaches its last group as at most ``salts`` rows.

Defined results: a null text equals the empty text.  Of equal texts the largest doc_id stays;
a null doc_id loses to any other.  Rows that repeat both doc_id and text are all marked as kept
by ``decisions`` (nothing tells them apart), while ``deduplicate`` returns one of them.  No rows
in, no rows out.  Other columns, whatever their names, are carried by ``deduplicate`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm.registry import query, table
from gridloom.llm.rows import is_plain, plain
from gridloom.session import stage

SALTS = 32


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _winners(rows: DataFrame, best: dict[str, Column], again: dict[str, Column]) -> DataFrame:
    salted = rows.groupBy("digest", "salt", "text").agg(*(c.alias(k) for k, c in best.items()))
    return salted.groupBy("digest", "text").agg(*(c.alias(k) for k, c in again.items()))


def _rows(docs: DataFrame, text: str, key: str, salts: int, *more: Column) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    spread = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(salts)).cast("int")
    return docs.select(F.col(f"`{key}`").alias("key"), whole.alias("text"), spread.alias("salt"), *more).withColumn(
        "digest", digest(F.col("text"))
    )


def decisions(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """(key, keep_key, group_size, kept, digest) for every row of ``docs``."""
    rows = _rows(docs, text, key, salts)
    won = _winners(rows, {"keep_key": F.max("key"), "n": F.count("*")}, {"keep_key": F.max("keep_key"), "n": F.sum("n")})
    # A text that occurs once needs nothing from its group but its digest, which a copied text may share.
    won = stage(won.select("digest", F.when(F.col("n") > 1, F.col("text")).alias("text"), "keep_key", "n"), "copies")
    groups = won.where("n > 1")
    clash = won.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if clash.isEmpty():
        found = groups.select(F.col("digest").alias("d"), "keep_key", "n")
        out = rows.join(found, F.col("digest") == F.col("d"), "left")
    else:
        # Two texts share a digest: the texts themselves decide here as well.
        found = groups.select(F.col("digest").alias("d"), F.col("text").alias("t"), "keep_key", "n")
        out = rows.join(found, (F.col("digest") == F.col("d")) & (F.col("text") == F.col("t")), "left")
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("key")).otherwise(F.col("keep_key"))
    return out.select(
        "key",
        keep.alias("keep_key"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("key").eqNullSafe(keep).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns."""
    others = [c for c in docs.columns if c != text]
    carried = F.struct(F.col(f"`{key}`").alias("key"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    # A null text is kept as it was unless an empty one wins.
    absent = F.col(f"`{text}`").isNull()
    if all(is_plain(docs, c) for c in others):
        rows = _rows(docs, text, key, salts, carried.alias("best"), absent.alias("absent"))
        rows = rows.withColumn("best", F.struct("best", "absent"))
        won = _winners(rows, {"best": F.max("best")}, {"best": F.max("best")})
    else:
        # A column without an order takes part in ties as JSON.
        order = F.struct(F.col(f"`{key}`"), *plain(docs, others), absent)
        rows = _rows(docs, text, key, salts, F.struct(carried.alias("best"), absent.alias("absent")).alias("best"), order.alias("order"))
        first = {"best": F.max_by("best", "order"), "order": F.max("order")}
        won = _winners(rows, first, first)
    back = [
        F.when(~F.col("best.absent"), F.col("text")).alias(text) if c == text else F.col(f"best.best.row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return won.select(*back)


@query(
    "op9_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
              doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decisions(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("key").alias("doc_id"),
        F.col("keep_key").alias("keep_id"),
        "group_size",
        "kept",
        F.col("digest").alias("text_sha256"),
    )
