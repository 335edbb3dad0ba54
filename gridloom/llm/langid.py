"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (DIMENSIONS long, drawn from a seed and the letter).
The vectors of three letters in a row are bound into one: the first is permuted (rotated) twice,
the second once, and the three are multiplied.  A text bundles (adds up) the vectors of all its
letter trigrams, a run of other characters counting as one blank; a language's prototype bundles
its training texts, each scaled to length 1.  What all languages share (the mean prototype) is
taken out, and a document has the language whose prototype has the largest cosine with it.

Prototypes are learned from about LEARN_ROWS documents of each language (all of a rarer one),
taken by hash of doc_id, outside the held-out third; every document is compared, over its whole
text.  Unicode letters count, lower-cased.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text
if no language could be learned.  Ties go to the first language in order of code points.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.bytetext import text_slices
from gridloom.llm.features import held_out
from gridloom.llm.registry import query, table
from gridloom.session import broadcast_if_small, stage

DIMENSIONS = 1024
LEARN_ROWS = 1500
SEED = 7
KEPT_TRIGRAMS = 50_000
_BLANK = 32


class Letters:
    """Code point to lower-cased letter, 32 for everything else; built once for a worker."""

    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            found = np.full(0x110000, _BLANK, np.uint32)
            for code in range(0x110000):
                char = chr(code)
                if char.isalpha():
                    low = char.lower()
                    found[code] = ord(low) if len(low) == 1 else code
            cls._table = found
        return cls._table


class Trigrams:
    """Vectors of letter trigrams, made when first seen; the least recently used are given up."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: OrderedDict[int, np.ndarray] = OrderedDict()

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            draw = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = 2 * draw - 1
        return self.letters[code]

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), self.dimensions), np.float32)
        for place, i in enumerate(ids.tolist()):
            row = self.rows.get(i)
            if row is None:
                a, b, c = i >> 42, i >> 21 & 0x1FFFFF, i & 0x1FFFFF
                row = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
                self.rows[i] = row
                if len(self.rows) > KEPT_TRIGRAMS:
                    self.rows.popitem(last=False)
            out[place] = row
        return out


def bundles(column: pa.Array, trigrams: Trigrams):
    """(first row, row after the last, vectors (rows x dimensions), rows with a letter) for slices of a column."""
    for row, end, data, at in text_slices(column, 1 << 20):
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # Bytes that begin a character tell where the rows begin among the characters.
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = begins[at] if begins[-1] == len(codes) else None
        if bounds is None:  # broken UTF-8: character by character, row by row
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            bounds = np.cumsum([0, *map(len, texts)])
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        low = Letters.table()[codes].astype(np.int64)
        of = np.repeat(np.arange(end - row), np.diff(bounds))
        keep = np.ones(len(low), bool)
        if len(low):
            keep[1:] = (low[1:] != _BLANK) | (low[:-1] != _BLANK) | (of[1:] != of[:-1])
        low, of = low[keep], of[keep]
        has = np.bincount(of[low != _BLANK], minlength=end - row) > 0
        # A blank before and after each row, so that short rows have trigrams too.
        edge = np.searchsorted(of, np.arange(end - row + 1))
        low = np.insert(low, np.repeat(edge, 2)[1:-1], _BLANK) if end > row else low
        of = np.repeat(np.arange(end - row), np.diff(edge) + 2)
        ids = (low[:-2] << 42) | (low[1:-1] << 21) | low[2:]
        ids, of_id = ids[of[:-2] == of[2:]], of[:-2][of[:-2] == of[2:]]
        out = np.zeros((end - row, trigrams.dimensions), np.float32)
        distinct, place = np.unique(ids, return_inverse=True)
        # Documents by distinct trigrams, some trigrams at a time: one matrix product each.
        for a in range(0, len(distinct), 4096):
            part = (place >= a) & (place < a + 4096)
            width = min(4096, len(distinct) - a)
            counts = np.bincount(of_id[part] * width + place[part] - a, minlength=(end - row) * width).reshape(end - row, width)
            out += counts.astype(np.float32) @ trigrams.vectors(distinct[a : a + 4096])
        yield row, end, out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", dimensions: int = DIMENSIONS, rows: int = LEARN_ROWS, seed: int = SEED):
    """(languages, prototypes): one row of numbers for each learned language."""
    k = F.col(f"`{key}`")
    given = docs.select(k.alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    given = given.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    # A row for each language: counted first, so that no text moves.
    share = stage(given.groupBy("lang").agg((F.lit(float(rows)) / F.count("*")).alias("share")), "shares")
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = given.join(broadcast_if_small(share, share.count()), "lang").where(draw < F.col("share")).select("lang", "text")

    def bundle(batches):
        trigrams, sums = Trigrams(dimensions, seed), {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, end, vectors, has in bundles(batch.column(1), trigrams):
                for name, vector, good in zip(names[row:end], _unit(vectors), has, strict=True):
                    if good:
                        sums[name] = sums.get(name, 0) + vector.astype(float)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "bundle": [np.round(v, 6).tolist() for v in sums.values()]})

    parts = sample.mapInArrow(bundle, "lang string, bundle array<double>")
    # A number for each language and dimension comes to the driver.
    whole = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    whole = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("bundle")).orderBy("lang").collect()
    names = [r["lang"] for r in whole]
    found = _unit(np.array([[v for _, v in r["bundle"]] for r in whole]).reshape(len(names), dimensions))
    return names, _unit(found - found.mean(0)) if len(names) > 1 else found, found.mean(0) if len(names) > 1 else np.zeros(dimensions)


def predict(docs: DataFrame, model, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(key, lang_pred, score) for every row; the score is the cosine, 0 where it is negative."""
    names, prototypes, common = model

    def run(batches):
        trigrams = Trigrams(prototypes.shape[1], seed)
        for batch in batches:
            for row, end, vectors, has in bundles(batch.column(1), trigrams):
                if names:
                    cosine = _unit(_unit(vectors) - common) @ prototypes.T
                    best = cosine.argmax(1)
                    found = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
                    how = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
                else:
                    found, how = ["und"] * (end - row), np.zeros(end - row)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], pa.array(found), pa.array(how.astype(float))], ["key", "lang_pred", "score"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(run, f"key {dict(given.dtypes)['key']}, lang_pred string, score double")


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
