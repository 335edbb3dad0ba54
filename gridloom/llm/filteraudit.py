"""Filter interaction audit: what each filter removes in every order, from one walk over the filter subsets.

**Cells.**  Every document gets a mask, bit i set if it fails filter i.  Documents are counted by part and mask
(partly summed where they are read), with those labelled good and toxic beside them: at most 2**n cells a part.

**Walk.**  The subsets of filters are walked in Gray-code order, so each step toggles one filter.  Every mask
cell has a counter of the active filters it fails; toggling a filter changes the counters of the cells with its
bit, and a cell that leaves or reaches zero takes its documents out of, or back into, the running survivors.  The
survivors of all 2**n subsets are stored.  Any step of any order is then a difference of two of them: kept =
S(before and f), removed = S(before) - S(before and f).

The counters do not depend on the part, so one walk serves all parts of a batch at once.  Parts are grouped by
key and spread over tasks; a task holds PARTS_A_STEP parts at a time, and no document leaves the task it was
read in but as a digest of its text (filter E) and its key (labels).

Filter E needs the smallest key among equal texts.  Digests (SHA-256) are grouped with partial aggregation; only
those that occur more than once are joined back to the rows, broadcast if they are counted and few, else by
digest, where a hot digest is one row on its side.

Defined results: a null text is empty, a null source the empty part.  A null key is never larger or smaller than
another: it fails no comparison and causes none.  Repeated rows each count; equal keys do not precede each other.
Of a key labelled more than once any good or toxic label counts; null labels and rows without key have none.
Other columns are neither read nor changed.  No rows in, no rows out.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm.registry import query, table
from gridloom.session import broadcast_if_small, stage

PARTS_A_STEP = 128
WORD_GAP = "[\\x20\\x09-\\x0D]+"
COUNTS = ("n", "good", "toxic")


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (key, digest, ...) with ``again``: a row with a smaller key has the same digest."""
    groups = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    groups = stage(groups.select(F.col("digest").alias("__digest"), "first"), "copies")
    out = rows.join(broadcast_if_small(groups, groups.count()), F.col("digest") == F.col("__digest"), "left")
    return out.withColumn("again", F.coalesce(F.col("first") < F.col("key"), F.lit(False))).drop("__digest", "first")


def corpus_filters(text: Column) -> list[Column]:
    """Failure of: too few words, too few distinct ones, too many capitals, odd symbols."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 200,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        F.lit(100) * capitals > F.lit(2) * F.length(text),
        F.rlike(text, F.lit("[#$%&*|]")),
    ]


def masks(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(key, part, mask) of every row: bit i for filter i of ``corpus_filters``, the last bit for a repeated text."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    fails = corpus_filters(whole)
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails[1:], 1)), fails[0].cast("int"))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        bits.cast("int").alias("bits"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
    )
    # Read the texts once; what follows needs a few bytes a row.
    found = repeats(stage(rows, "masks"))
    return found.select("key", "part", (F.col("bits") + F.col("again").cast("int") * (1 << len(fails))).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic) of ``rows`` (key, part, mask)."""
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    if labels is None:
        return counted
    k, is_one = F.col(f"`{key}`"), lambda c: F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("long"))
    marked = labels.where(k.isNotNull()).groupBy(k.alias("__key")).agg(is_one(good).alias("good"), is_one(toxic).alias("toxic"))
    marked = stage(marked.where("good + toxic > 0"), "labelled")
    held = rows.join(broadcast_if_small(marked, marked.count()), F.col("key") == F.col("__key"))
    lost = held.groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counted.unionByName(lost).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def survivors(counts: np.ndarray, n: int) -> np.ndarray:
    """Documents that pass each subset of ``n`` filters: counts (parts, 2**n masks, ...) to (parts, 2**n subsets, ...)."""
    states = 1 << n
    mask = np.arange(states)
    failing = np.zeros(states, int)  # active filters that a mask cell fails
    alive = counts.sum(axis=1)
    out = np.empty_like(counts)
    out[:, 0] = alive
    active = 0
    for step in range(1, states):
        bit = (step & -step).bit_length() - 1
        active ^= 1 << bit
        holds = mask >> bit & 1 == 1
        if active >> bit & 1:
            gone = holds & (failing == 0)
            failing[holds] += 1
            alive = alive - counts[:, gone].sum(axis=1)
        else:
            failing[holds] -= 1
            alive = alive + counts[:, holds & (failing == 0)].sum(axis=1)
        out[:, active] = alive
    return out


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


class _Steps:
    """All orders and steps of some filters, as indices of subsets."""

    def __init__(self, letters: str):
        self.n, self.orders = len(letters), orders(letters)
        bit = {c: 1 << i for i, c in enumerate(letters)}
        own = np.array([[bit[c] for c in order] for order in self.orders])
        self.own = own.ravel()
        self.after = own.cumsum(axis=1).ravel()
        self.before = self.after - self.own
        self.filter = np.log2(self.own).astype(int)
        self.name = np.repeat(np.arange(len(self.orders)), self.n)
        self.step = np.tile(np.arange(1, self.n + 1, dtype=np.int32), len(self.orders))

    def table(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Columns (parts, orders x steps) of the report."""
        s = survivors(counts, self.n)
        lost = s[:, self.before] - s[:, self.after]
        removed = lost[:, :, 0]
        every = (1 << self.n) - 1
        failing = s[:, [0], 0] - s[:, 1 << np.arange(self.n), 0]
        unique = s[:, every - (1 << np.arange(self.n)), 0] - s[:, [every], 0]
        shapley = np.stack([removed[:, self.filter == f].sum(axis=1) for f in range(self.n)], axis=1)
        return {
            "kept": s[:, self.after, 0], "removed": removed, "redundant": failing[:, self.filter] - removed, "unique_fails": unique[:, self.filter],
            "good_lost": lost[:, :, 1], "toxic_lost": lost[:, :, 2], "shapley": shapley[:, self.filter],
        }


REPORT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of ``letters`` and step; ``counted``: (part, mask, n, good, toxic).

    The report has n! orders, so it is for a handful of filters.
    """
    states = 1 << len(letters)
    # At most ``states`` cells a part.
    lists = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def run(batches):
        steps = _Steps(letters)
        names = pa.array(steps.orders)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_A_STEP):
                some = batch.slice(at, PARTS_A_STEP)
                held = some.column(1).flatten()
                mask, *values = (c.to_numpy(zero_copy_only=False) for c in held.flatten())
                of = np.repeat(np.arange(some.num_rows), some.column(1).value_lengths().to_numpy(zero_copy_only=False))
                counts = np.zeros((some.num_rows, states, len(COUNTS)), np.int64)
                np.add.at(counts, (of, mask), np.column_stack(values))
                report = steps.table(counts)
                rows = len(steps.step)
                part = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), rows)))
                order = names.take(pa.array(np.tile(steps.name, some.num_rows)))
                step = pa.array(np.tile(steps.step, some.num_rows))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(report[c].ravel()) for c in REPORT)], ["part", "filter_order", "step", *REPORT])

    return lists.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in REPORT))


@query(
    "op11_filter_audit",
    r"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
    fails AS (
        SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x,
               (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
               + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS f
        FROM docs LEFT JOIN marks USING (doc_id)),
    cells AS (SELECT part, f, count(*) AS n, sum(q) AS q, sum(x) AS x FROM fails GROUP BY part, f),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
               WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
    steps AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
                     (SELECT coalesce(sum(1 << (ascii(c) - 65)), 0)::INT FROM letters WHERE contains(substr(filter_order, 1, step - 1), c)) AS before
              FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
    seen AS (SELECT part, filter_order, step, own, n, q, x, f & own > 0 AS here, f & before > 0 AS earlier, bit_count(f) = 1 AS only_one FROM cells, steps),
    told AS (
        SELECT part, filter_order, step, own,
               coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
               coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND only_one), 0) AS unique_fails,
               coalesce(sum(q) FILTER (here AND NOT earlier), 0) AS good_lost, coalesce(sum(x) FILTER (here AND NOT earlier), 0) AS toxic_lost
        FROM seen GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM told""",
)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(cells(masks(docs), labels), "ABCDE")
