"""Source divergence audit: how far the term distributions of a language's sources lie apart.

**Late string materialization.**  A task splits its texts into terms and sums them by group and term
(``term_counts``).  Only a 64-bit digest of fixed width leaves the task for a term, never its string.  A second
aggregate finds the least and the greatest string of each digest that is kept; where the two differ the digest
stands for several strings, and its counts are taken again with the string beside it.  Strings are joined back
for the rows of the ``term`` report alone.

**Terms and probabilities.**  Terms are runs of ASCII letters and of characters outside ASCII, A-Z lower-cased.
A language keeps the terms that at least ``least`` of its documents hold.  The smoothed probability of a kept term
in a group (language and source), and in the language, is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), by integer
long division.

**Pairs.**  The L1 distances of all sources of a language are summed block by block: a block holds some of the
kept terms (by digest) for a tile of sources times a tile of sources as a dense matrix, and gives one partial sum
a pair.  Matrices have at most 2 TILE rows and about BLOCK_TERMS columns, whatever the number of sources and
terms; no pair of rows is made for a term.

Defined results: null text, language and source are the empty string; every document counts, repeated rows too.
A language without kept terms has pairs of value 0 and no terms.  A language with one source has no pairs.  No
rows in, no rows out.  Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.llm.bytetext import BYTE_VALUE, LOWER, mix, powers, text_slices
from gridloom.llm.registry import query, table
from gridloom.session import broadcast_if_small, broadcast_limit, stage

LEAST_DOCUMENTS = 30
SCALE_DIGITS = 9
TOP = 50
#: Sources and (about) terms of a matrix.
TILE, BLOCK_TERMS = 256, 1024
SLICE = 8 << 20

Digests = Callable[[pa.StringArray], np.ndarray]

_GAP = np.ones(256, bool)
_GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_KEY = ["lang", "digest", "split"]


def digests(terms: pa.StringArray) -> np.ndarray:
    """64-bit digests of strings that are not empty."""
    if not len(terms):
        return np.zeros(0, np.int64)
    _, ends, data = terms.buffers()
    at = np.frombuffer(ends, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    length = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], length)
    sums = np.add.reduceat(BYTE_VALUE[raw] * powers(int(length.max()))[place], at[:-1] - at[0])
    return mix(sums + mix(length.astype(np.uint64))).view(np.int64)


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row of every term of a slice, in order, and the terms."""
    inside = ~_GAP[data]
    firsts = at[:-1][at[:-1] < at[1:]]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[firsts] = True
    edge[0] = True
    cut = np.flatnonzero(edge)
    begin = cut[:-1][inside[cut[:-1]]] if len(data) else cut[:0]
    row = np.searchsorted(at, begin, "right") - 1
    length = (cut[1:] - cut[:-1])[inside[cut[:-1]]] if len(data) else begin
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    kept = LOWER[data[inside]]
    return row, pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(kept.tobytes()))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", strings: bool = False, hashed: Digests = digests) -> DataFrame:
    """(lang, source, digest, n, docs): summed within slices of about SLICE bytes of the tasks' texts.

    ``strings`` adds the term, one row for each term of a slice.
    """

    def run(batches):
        for batch in batches:
            # The batch's groups by number.
            langs, sources = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
            many = max(len(sources.dictionary), 1)
            group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + sources.indices.to_numpy(zero_copy_only=False)
            for first, _, data, at in text_slices(batch.column(0), SLICE):
                row, terms = _terms(data, at)
                if not len(row):
                    continue
                coded = terms.dictionary_encode()
                size = len(coded.dictionary)
                in_row, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
                pair, back = np.unique(group[first + in_row // size] * size + in_row % size, return_inverse=True)
                of, term = pair // size, pair % size
                columns = {
                    "lang": langs.dictionary.take(pa.array(of // many)), "source": sources.dictionary.take(pa.array(of % many)), "digest": pa.array(hashed(coded.dictionary)[term]),
                    "n": pa.array(np.bincount(back, weights=n).astype(np.int64)), "docs": pa.array(np.bincount(back)),
                }
                if strings:
                    columns["term"] = coded.dictionary.take(pa.array(term))
                yield pa.RecordBatch.from_pydict(columns)

    return _read(docs, text, lang, source).mapInArrow(run, "lang string, source string, digest long, n long, docs long" + ", term string" * strings)


def term_strings(docs: DataFrame, text: str = "text", hashed: Digests = digests) -> DataFrame:
    """(digest, term): every term at least once."""

    def run(batches):
        for batch in batches:
            for _, _, data, at in text_slices(batch.column(0), SLICE):
                terms = _terms(data, at)[1].unique()
                yield pa.RecordBatch.from_pydict({"digest": pa.array(hashed(terms)), "term": terms})

    return _read(docs, text).mapInArrow(run, "digest long, term string")


def _read(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in zip(columns, ("text", "lang", "source"))))  # noqa: B905


def scaled_share(part: Column, whole: Column, digits: int = SCALE_DIGITS) -> Column:
    """1 + floor(10^digits * part / whole) by long division, three digits a step; exact while whole < 9.2e15."""
    if digits % 3:
        raise ValueError("three digits a step")
    share, rest = F.lit(0).cast("long"), part
    for _ in range(digits // 3):
        grown = rest * 1000
        share, rest = share * 1000 + F.call_function("div", grown, whole), grown % whole
    return share + 1


class Audit:
    """The counted tables of a corpus, from which both reports come."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS, text: str = "text", lang: str = "lang", source: str = "source", hashed: Digests = digests):
        counts, kept, self.strings = _kept_terms(docs, least, text, lang, source, hashed)
        langs = stage(kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v")), "langs")
        blocks = broadcast_if_small(langs.select("lang", F.ceil(F.col("v") / BLOCK_TERMS).alias("blocks")), langs.count())
        block = F.pmod(F.xxhash64("digest", "split"), F.col("blocks")).cast("int").alias("block")
        #: (lang, digest, split, lang_n, block)
        self.kept = stage(kept.join(blocks, "lang").select("lang", "digest", "split", F.col("n").alias("lang_n"), block), "kept")
        self.kept_rows = self.kept.count()
        held = counts.join(broadcast_if_small(self.kept, self.kept_rows), _KEY)
        #: (lang, source, digest, split, block, n, lang_n): the kept terms that a group has.
        self.cells = stage(held.select("lang", "source", "digest", "split", "block", "n", "lang_n"), "cells")
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = _read(docs, text, lang, source).select("lang", "source").distinct()
        groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "v"])
        #: (lang, source, v, whole, lang_whole): every group; the wholes are the denominators of the shares.
        groups = groups.select("lang", "source", "v", *((F.col(c) + 5 * F.col("v")).alias(k) for c, k in (("total", "whole"), ("lang_total", "lang_whole"))))
        self.groups = stage(groups, "groups")
        self.group_rows = self.groups.count()

    def _shares(self) -> DataFrame:
        """Cells with the group's and the language's probability."""
        sizes = self.groups.select("lang", "source", "whole", "lang_whole")
        rows = self.cells.join(broadcast_if_small(sizes, self.group_rows), ["lang", "source"])
        return rows.withColumn("p", scaled_share(F.col("n") + 5, F.col("whole"))).withColumn("q", scaled_share(F.col("lang_n") + 5, F.col("lang_whole")))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank) of the terms that a group uses more than its language."""
        ahead = self._shares().where("p > q").select("lang", "source", "digest", "split", (F.col("p") - F.col("q")).alias("value"))
        of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        # By value alone, ties at the end included; strings are fetched for these rows only.
        near = ahead.withColumn("at", F.rank().over(of_group)).where(F.col("at") <= top).drop("at")
        named = near.join(self.strings, ["digest", "split"])
        by_name = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return named.withColumn("rank", F.row_number().over(by_name)).where(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")

    def pairs(self, tile: int = TILE) -> DataFrame:
        """(lang, source, item, value, rank): distance from every other source of the language."""
        numbered = self.groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        # The share of a term that a source lacks; languages without kept terms have no denominator.
        numbered = numbered.withColumn("base", scaled_share(F.lit(5).cast("long"), F.greatest(F.col("whole"), F.lit(5))))
        numbered = numbered.withColumn("tile", F.floor(F.col("place") / tile).cast("int"))
        numbered = stage(numbered.withColumn("tiles", (F.max("tile").over(Window.partitionBy("lang")) + 1)), "numbered")
        known = broadcast_if_small(numbered.select("lang", "source", "place", "tile", "tiles", "base", "whole"), self.group_rows)
        zero = F.lit(0).cast("long")
        shares = self.cells.join(known, ["lang", "source"]).select(
            "lang", "block", "tile", "tiles", "place", "base", "digest", "split", scaled_share(F.col("n") + 5, F.col("whole")).alias("p"), zero.alias("width")
        )
        # Every source in every block of its language, marked by p = -1, with the number of the block's terms.
        widths = self.kept.groupBy("lang", "block").agg(F.count("*").alias("width"))
        every = numbered.join(widths, "lang", "left").select(
            "lang", F.coalesce("block", F.lit(0)).alias("block"), "tile", "tiles", "place", "base", zero.alias("digest"), F.lit("").alias("split"),
            F.lit(-1).cast("long").alias("p"), F.coalesce("width", zero).alias("width"),
        )
        # Tile t meets tiles 0 .. t as the later one and t .. last as the earlier one.
        both = shares.unionByName(every).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        both = both.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other"))
        parts = both.groupBy("lang", "block", "a", "b").applyInArrow(_distances, "lang string, x long, y long, value long")
        sums = parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
        names = broadcast_if_small(numbered.select("lang", F.col("place").cast("long").alias("place"), F.col("source").alias("name")), self.group_rows)
        out = sums.join(names.withColumnsRenamed({"place": "x", "name": "source"}), ["lang", "x"]).join(names.withColumnsRenamed({"place": "y", "name": "item"}), ["lang", "y"])
        ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return out.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", "item", "value", "rank")


def _counts(rows: DataFrame) -> DataFrame:
    return stage(rows.groupBy("lang", "source", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def _kept(counts: DataFrame, least: int) -> DataFrame:
    return stage(counts.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")


def _strings(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(digest, least, greatest string) of the kept digests."""
    wanted = stage(kept.select("digest").distinct(), "digests")
    rows = wanted.count()
    ends = lambda rows: rows.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest"))
    # Few digests: drop the other strings where they are.  Many: combine equal strings before they move.
    few = rows <= broadcast_limit(found.sparkSession)
    held = ends(found.join(F.broadcast(wanted), "digest", "left_semi")) if few else ends(found).join(wanted, "digest", "left_semi")
    return stage(held, "strings")


def _kept_terms(docs: DataFrame, least: int, text: str, lang: str, source: str, hashed: Digests) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (lang, source, digest, split, n, docs), kept terms (lang, digest, split, n) and their strings (digest, split, item).

    ``split`` is empty but for digests of several strings, where it is the string.  The texts are read twice,
    for the counts and for the strings, which costs less than writing the terms of all tasks.
    """
    counts = _counts(term_counts(docs, text, lang, source, hashed=hashed).withColumn("split", F.lit("")))
    kept = _kept(counts, least)
    ends = _strings(term_strings(docs, text, hashed), kept)
    clash = stage(ends.where("least < greatest").select("digest"), "clashes")
    if clash.isEmpty():
        return counts, kept, ends.select("digest", F.lit("").alias("split"), F.col("least").alias("item"))
    several = term_counts(docs, text, lang, source, True, hashed).join(clash, "digest", "left_semi").withColumnRenamed("term", "split")
    apart = _counts(several)
    counts = stage(counts.join(clash, "digest", "left_anti").unionByName(apart), "counts")
    single = ends.where("least = greatest").select("digest", F.lit("").alias("split"), F.col("least").alias("item"))
    return counts, _kept(counts, least), single.unionByName(apart.select("digest", "split", F.col("split").alias("item")).distinct())


def _distances(held: pa.Table) -> pa.Table:
    """Partial L1 distances of the sources of two tiles over the terms of a block."""
    get = lambda c: held.column(c).to_numpy()
    place, p = get("place"), get("p")
    marks = p < 0
    sources, first = np.unique(place[marks], return_index=True)
    base = get("base")[marks][first]
    tile = get("tile")[marks][first]
    width = int(get("width")[marks].max())
    of = np.searchsorted(sources, place[~marks])
    # Terms of the block by number; equal ones have the same digest and, if that is split, the same string.
    live = held.filter(pa.array(~marks))
    term = pc.dictionary_encode(pc.binary_join_element_wise(live.column("digest").cast(pa.string()), live.column("split"), " ")).combine_chunks()
    column = term.indices.to_numpy() if len(live) else np.zeros(0, np.int64)
    used = len(term.dictionary) if len(live) else 0
    matrix = np.repeat(base[:, None], used, axis=1)
    matrix[of, column] = p[~marks]
    a, b = held.column("a")[0].as_py(), held.column("b")[0].as_py()
    rows, columns = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    out = []
    for x in rows:
        apart = np.abs(matrix[columns] - matrix[x]).sum(axis=1) + (width - used) * np.abs(base[columns] - base[x])
        other = columns != x
        out.append((np.full(other.sum(), sources[x]), sources[columns[other]], apart[other]))
        if a != b:
            out.append((sources[columns], np.full(len(columns), sources[x]), apart))
    x, y, value = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 3))
    lang = pa.array([held.column("lang")[0].as_py()] * len(x), pa.string())
    return pa.table([lang, pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(value.astype(np.int64))], ["lang", "x", "y", "value"])


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the pairs and the terms of every group."""
    audit = Audit(docs, least, text, lang, source)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return audit.pairs().withColumn("part", F.lit("pair")).select(columns).unionByName(audit.terms(top).withColumn("part", F.lit("term")).select(columns))


@query(
    "op12_source_divergence",
    r"""
    WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL),
    kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
    sources AS (SELECT DISTINCT lang, source FROM docs),
    cells AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n FROM sources s JOIN kept k ON k.lang = s.lang
              LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    totals AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS whole, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_whole FROM cells),
    shares AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n::HUGEINT + 5) // (whole::HUGEINT + 5 * v) AS p,
                      1 + 1000000000::HUGEINT * (lang_n::HUGEINT + 5) // (lang_whole::HUGEINT + 5 * v) AS q FROM totals JOIN sizes USING (lang)),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
    pairs AS (SELECT s.lang, s.source, o.source AS item, coalesce(value, 0) AS value FROM sources s JOIN sources o ON s.lang = o.lang AND s.source <> o.source
              LEFT JOIN apart d ON d.lang = s.lang AND d.source = s.source AND d.item = o.source),
    told AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
             UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM told
    QUALIFY part = 'pair' OR rank <= 50""",
)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
