"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles (64-bit hashes; A-Z lower-cased).  The sets that
two documents share exactly are one class, found first by a digest of the set; everything after
works on classes.

**Sketch.**  Each shingle flips one bit of a bit sketch, so bits that differ between two sketches
are at most the shingles that only one of the documents has.  A pair with Jaccard t or more has at
most (a + b)(1 - t)/(1 + t) of these.

**Size bands.**  Band i holds the sets of size [t^-2i, t^-2(i+1)).  A pair is joined in the band of
its smaller set; a set goes to its own band and, if it can be the larger one of a pair there, to
the band before.  Within a band every pair differs in at most d bits.

**Pigeonhole.**  A band's sketch is cut into d + 1 + e blocks; a pair agrees in at least e + 1 of
them.  The sketch is so wide (2^60 bits a block, held as an XOR of hashes) that equal blocks mean
equal shingles there.  Blocks without shingles say nothing: a set with s of them leaves them out and
counts on e + 1 - s of the others (a set with more than e uses them too, and meets only its like).
Of the e + 1 - s agreements one is enough, so each set drops its e - s most shared blocks, all sets by
the same order: what a pair has in common loses at most its first e - s blocks, and one is left.  A
passage that many documents share is dropped so, and a set that shares no more than e - s blocks with
anyone is done.

**Verify.**  Sets that share a block are compared by a folded sketch (Hamming distance within the
bound), and those that pass by the shingles themselves.  A block shared by many sets does not emit
its pairs: its sets are compared with two of them (least and greatest hash), by HUB_ROUNDS more pairs of hubs where they are not connected, then only sets
not yet connected are compared with each other, and the folded sketch is a condition of that join.

Defined results: a null text or one without words has an empty set, is linked with nothing and is
its own component (component_id is its own doc_id).  A text with fewer words than a shingle has
its whole sequence as its one shingle.  component_id is the smallest doc_id of the component; null
doc_ids are ignored there (their texts are linked like any others), and rows that repeat a doc_id are treated by their texts.  No rows in,
no rows out.  Only the text and key columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.llm.bytetext import Words, mix, shingles, text_slices
from gridloom.llm.components import components
from gridloom.llm.registry import query, table
from gridloom.session import broadcast_if_small, stage

_U = np.uint64
HUB_ROUNDS = 2
#: Block keys that are shuffled at once, and most slices of them: more keys make larger slices.
SLICE_ROWS, SLICES = 16_000_000, 8
#: Longs of the folded sketch, by set size below: two bits a shingle or more, up to 8192.
FOLD = ((128, 4), (512, 16), (2048, 64), (1 << 62, 256))


class Bands:
    """Sizes, differences and blocks of the size bands for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.step = math.log((100 / percent) ** 2) if percent < 100 else 1.0

    def of(self, size: int) -> int:
        band = int(math.log(size) / self.step)
        while band and size < self.low(band):
            band -= 1
        while size >= self.low(band + 1):
            band += 1
        return band

    def low(self, band: int) -> int:
        return math.ceil(math.exp(band * self.step) - 1e-9) if band else 1

    def partner(self, smaller: int) -> int:
        """Largest set that can reach the threshold with a set of this size."""
        return smaller * 100 // self.percent

    def differ(self, total: int) -> int:
        """Most shingles that only one of two sets has, if their sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def blocks(self, band: int) -> tuple[int, int]:
        """(blocks, spare e) of a band; (0, 0) where a pair can only be equal sets."""
        most = self.low(band + 1) - 1
        differ = self.differ(most + self.partner(most))
        if not differ:
            return 0, 0
        # The empty blocks of the smallest sets with two deviations, and a tenth more to spare.
        size, spare = self.low(band), 1
        for _ in range(20):
            total = differ + 1 + spare
            empty = total * math.exp(-size / total)
            wanted = math.ceil(empty + 2 * math.sqrt(empty) + total / 10)
            if wanted <= spare:
                break
            spare = wanted
        return differ + 1 + spare, spare

    def homes(self, size: int) -> list[int]:
        """Bands that a set of this size is joined in."""
        own = self.of(size)
        return [own, own - 1] if own and self.partner(self.low(own) - 1) >= size else [own]


def _sets(batches, k: int) -> Iterator[tuple[tuple[pa.Array, pa.Array], list[np.ndarray]]]:
    for batch in batches:
        ids, marks = batch.column(0), batch.column(2)
        for row, end, data, at in text_slices(batch.column(1)):
            found, begin = shingles(Words(data, at), k)
            yield (ids[row:end], marks[row:end]), [np.unique(found[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _fold(found: np.ndarray) -> np.ndarray:
    words = next(w for below, w in FOLD if len(found) < below)
    z = mix(found ^ _U(0x51ED270B))
    out = np.zeros(words, _U)
    np.bitwise_xor.at(out, ((z >> _U(6)) & _U(words - 1)).astype(np.int64), _U(1) << (z & _U(63)))
    return out


def _node(found: np.ndarray) -> np.uint64:
    """Name of a set: XOR of its hashes, with its size."""
    return mix(np.bitwise_xor.reduce(mix(found), keepdims=True) + _U(len(found)))[0] if len(found) else _U(0)


def _list(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _classes_of(k: int):
    def run(batches):
        for (ids, marks), sets in _sets(batches, k):
            node = np.array([_node(s) for s in sets], _U)
            yield pa.RecordBatch.from_arrays(
                [ids, marks, pa.array([len(s) for s in sets], pa.int64()), pa.array(node.view(np.int64)), _list([_fold(s) for s in sets])],
                ["key", "mark", "n", "node", "fold"],
            )

    return run


def _keys_of(k: int, percent: int):
    bands = Bands(percent)

    def keys(found: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        for band in bands.homes(len(found)):
            blocks, spare = bands.blocks(band)
            if not blocks:
                continue
            at = ((mix(found ^ _U(band + 1)) >> _U(11)) % _U(blocks)).astype(np.int64)
            word = np.zeros(blocks, _U)
            np.bitwise_xor.at(word, at, mix(found))
            named = mix(word + mix(np.arange(blocks, dtype=_U) + _U(band << 32)))
            empty = np.bincount(at, minlength=blocks) == 0
            left = spare - int(empty.sum())
            # The last bit of the spare count tells a set's two bands apart.
            yield named if left < 0 else named[~empty], 2 * left + band % 2

    def run(batches):
        for _, sets in _sets(batches, k):
            node, named, left = [], [], []
            for s in sets:
                if len(s):
                    mine = _node(s)
                    for found, spare in keys(s):
                        named.append(found)
                        node.append(np.full(len(found), mine, _U))
                        left.append(np.full(len(found), spare, np.int32))
            if named:
                columns = [np.concatenate(named).view(np.int64), np.concatenate(node).view(np.int64), np.concatenate(left)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "node", "spare"])

    return run


def _members_of(k: int):
    def run(batches):
        for _, sets in _sets(batches, k):
            node = np.array([_node(s) for s in sets], _U)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), _list(sets)], ["node", "found"])

    return run


def _close(a: str, b: str, percent: int) -> Column:
    """Sizes and folded sketches allow the pair; sketches of different width say nothing."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    near = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    x, y = F.col(f"{a}_fold"), F.col(f"{b}_fold")
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return near & ((F.size(x) != F.size(y)) | (apart * (100 + percent) <= (n + m) * (100 - percent)))


def _verified(pairs: DataFrame, given: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingles reach the threshold; only the texts of these sets are read again."""
    pairs = stage(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = stage(nodes.join(classes.select("node", F.col("first").alias("key"), "mark"), "node"), "nodes")
    many = nodes.count()
    few = broadcast_if_small(nodes.where("key IS NOT NULL").select("key").distinct(), many)
    # A set whose documents all have no key is found by the mark of a text; copies of that are read once.
    bare = broadcast_if_small(nodes.where("key IS NULL").select("mark").distinct(), many)
    bare = given.where("key IS NULL").join(bare, "mark", "left_semi").dropDuplicates(["text"]).select("key", "text", "mark")
    texts = given.join(few, "key", "left_semi").select("key", "text", "mark").union(bare)
    sets = stage(texts.mapInArrow(_members_of(k), "node long, found array<long>"), "members")
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("a_found"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("b_found"))
    both = F.size(F.array_intersect("a_found", "b_found"))
    union = F.size("a_found") + F.size("b_found") - both
    found = pairs.join(right, "b").join(left, "a").where(both * 100 >= union * percent).select("a", "b").distinct()
    return stage(found, "found")


def _shared_blocks(keys: DataFrame) -> DataFrame:
    """Keys of the blocks that several sets hold, with the two hubs and the number of members.

    Most blocks hold one set and end here.  A hot block is counted by partial aggregates, and its rows
    are joined back where AQE may split them.  Blocks are taken in slices, so that the two shuffles of
    all keys never lie on disk at once.
    """
    slices = min(1 + keys.count() // SLICE_ROWS, SLICES)
    found = []
    for part in range(slices):
        mine = keys.where(F.pmod("block", F.lit(slices)) == part) if slices > 1 else keys
        groups = mine.groupBy("block").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("members"))
        found.append(stage(mine.join(groups.where("lo < hi"), "block"), "blocks"))
    return reduce(DataFrame.union, found)


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, roots): rows (key, mark, n, node) name the class of each document, links (a, b) join classes.

    Links are those between different sets that the join had to look at: enough to connect
    every component.  Roots (node, root) names the component of every linked class.
    """
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    given = given.withColumn("mark", F.xxhash64("text"))
    kind = dict(given.dtypes)["key"]
    rows = stage(given.mapInArrow(_classes_of(k), f"key {kind}, mark long, n long, node long, fold array<long>"), "sets")
    classes = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("first"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("fold").alias("fold"))
    classes = stage(classes, "classes")

    # Copies of a set need no keys of their own: one document stands for the class.
    spare = rows.where("n > 0").select("key", "node").join(classes.select("node", "first"), "node").where("key <> first").select("key")
    spare = stage(spare.distinct().join(classes.select(F.col("first").alias("key")), "key", "left_anti"), "copies")
    keys = given.join(spare, "key", "left_anti").mapInArrow(_keys_of(k, percent), "block long, node long, spare int")

    blocks = _shared_blocks(stage(keys, "keys"))
    # Every set leaves out its most shared blocks, as many as it can spare.
    rarest_last = Window.partitionBy("node", "spare").orderBy(F.col("members").desc(), "block")
    shared = blocks.withColumn("place", F.row_number().over(rarest_last)).where(F.col("place") > F.shiftright("spare", 1))
    shared = stage(shared.select("block", "node", "lo", "hi"), "shared")

    about = classes.select("node", "n", "fold")
    side = lambda s: about.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("fold").alias(f"{s}_fold"))
    ends = [F.struct(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b")) for hub in ("lo", "hi")]
    pairs = shared.select(F.explode(F.array(*ends)).alias("pair")).select("pair.a", "pair.b").where("a <> b").distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_close("a", "b", percent)).select("a", "b")
    links = _verified(pairs, given, classes, k, percent)
    roots = components(links)

    def open_sets(roots: DataFrame) -> DataFrame:
        """Sets of the blocks that hold more than one component so far."""
        placed = shared.select("block", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = stage(placed, "placed")
        apart = placed.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("block")
        return stage(placed.join(apart, "block", "left_semi"), "open")

    # Other hubs connect most of what is left of a large group, a few rows for each set.
    for turn in range(HUB_ROUNDS):
        drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")
        opened = open_sets(roots)
        if opened.isEmpty():
            return rows.drop("fold"), links, roots
        hubs = opened.groupBy("block").agg(F.array(F.min(drawn), F.max(drawn)).alias("hubs"))
        pairs = opened.join(hubs, "block").select("node", "root", F.explode("hubs").alias("hub")).where("hub.root <> root")
        pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_close("a", "b", percent)).select("a", "b")
        more = _verified(pairs, given, classes, k, percent)
        links, roots = links.union(more), components(more, roots)

    # Sets of a block that are not connected yet meet each other.
    placed = open_sets(roots).join(about, "node")
    a = placed.select("block", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "fold", "root")))
    b = placed.select("block", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "fold", "root")))
    apart = (a["block"] == b["block"]) & (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & _close("a", "b", percent)
    pairs = a.join(b, apart).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    more = _verified(pairs, given, classes, k, percent)
    return rows.drop("fold"), links.union(more), components(more, roots)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """(key, mark, n_shingles, component, stays) for every row of ``docs``; ``mark`` is a hash of the text.

    The row with the smallest key of its component stays; the marks decide between rows with that key.
    """
    rows, _, roots = join(docs, text, key, k, percent)
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stage(placed.select("key", "mark", "n", "root"), "placed")
    # A struct with a null key sorts first: rows without one are looked at only where no row has one.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark"))
    least = placed.where("n > 0").groupBy("root").agg(first.alias("least")).withColumnRenamed("root", "of")
    out = placed.join(least, (F.col("root") == F.col("of")) & (F.col("n") > 0), "left")
    alone = F.col("n") == 0
    return out.select(
        "key",
        "mark",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("key")).otherwise(F.col("least.key")).alias("component"),
        (alone | (F.col("key").eqNullSafe(F.col("least.key")) & (F.col("mark") == F.col("least.mark")))).alias("stays"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component."""
    kept = near_duplicates(docs, text, key, k, percent).where("stays").groupBy("key", "mark", "n_shingles").agg(F.count("*").alias("times"))
    kept = stage(kept, "kept")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    mark = F.xxhash64(F.col(f"`{text}`").cast("string"))
    out = docs.select(row.alias("row"), F.col(f"`{key}`").alias("k"), mark.alias("m"))
    one = kept.select("key", "mark", "n_shingles")
    out = out.join(one, F.col("k").eqNullSafe(F.col("key")) & (F.col("m") == F.col("mark")))
    if not kept.where("times > 1 AND n_shingles > 0").isEmpty():
        # Rows that repeat key and text: one of them; texts without words all stay.
        empty = out.where("n_shingles = 0").select("row")
        return empty.union(out.where("n_shingles > 0").dropDuplicates(["k", "m"]).select("row")).select("row.*")
    return out.select("row.*")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
             ELSE unnest(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM w WHERE len(w) > 0),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM c),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.low, w.doc_id) AS component_id
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = w.doc_id"""


@query("op2_jaccard_join", OP2_SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)
    return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
