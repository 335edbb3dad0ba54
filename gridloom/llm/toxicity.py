"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

**Lexicon.**  Terms are words and beginnings of words (3 to 9 bytes, by hash), lower-cased.  A term
is in the lexicon if it occurs in several toxic training texts and in hardly any other; texts count
once for each group of near copies (texts with the same least shingle hash).  Nothing is listed by
hand, so the lexicon has the terms of every language that the labels cover.

**Features.**  Density and number of lexicon hits, of strong ones, and their weight; hits near a
second-person word; hits that show only after look-alike characters are replaced and marks inside
words are dropped, and words written that way; capitals, punctuation and the other rates of
``features.profile``.

**Trees.**  The labelled texts are cut into two halves by hash; each half gets its features from the
lexicon of the other, so no tree learns from a term's own text.  Boosted trees are fitted on four
fifths of the rows and calibrated by isotonic regression on the last fifth.  Scoring uses the
lexicon of all training texts.

At most TRAIN_ROWS labelled rows outside the held-out third are learned from; every document is
scored, over its whole text.

Defined results: a null text is scored as the empty text.  Without toxic or without other training
texts the score is the share of toxic ones (0 without labels).  No rows in, no rows out.  Other
columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.bytetext import SPACE, Words, mix, shingles, text_slices
from gridloom.llm.features import NAMES, TRAIN_ROWS, held_out, profile, training
from gridloom.llm.registry import query, table
from gridloom.session import stage

_U = np.uint64
PREFIXES = range(3, 10)
LEAST_TEXTS = 3
LEAST_SHARE = 0.85
NEAR = 5
# Words that address the reader, in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself yourselves du dich dir dein deine deinen deiner ihr euch euer eure"
    " tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro vuestra"
)
# Characters written in place of letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in LOOKALIKES.items():
    _LEET[ord(_a)] = ord(_b)
_LEET_BYTE = np.isin(np.arange(256), [ord(c) for c in LOOKALIKES])


def _lowered(data: np.ndarray) -> np.ndarray:
    """Latin capitals of two bytes in lower case (those of one byte are left to Words)."""
    out = data.copy()
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[high] += 0x20
    return out


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)])).hashes()


_YOU = np.sort(_words(SECOND_PERSON))


def _terms(words: Words) -> np.ndarray:
    """Hashes of the whole words and of their beginnings, a row for each kind."""
    return np.hstack([np.zeros((1 + len(PREFIXES), 0), _U), *(found for _, _, found in words.beginnings(PREFIXES))])


@dataclass
class Lexicon:
    """Term hashes, ascending, with their weights; the table sorts out most words at once."""

    terms: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.terms & _U(0xFFFFF)).astype(np.int64)] = True

    def weight(self, words: Words) -> np.ndarray:
        """Largest weight of a word's terms; 0 where none is listed."""
        out = np.zeros(len(words.start))
        if not len(self.terms):
            return out
        for i, j, found in words.beginnings(PREFIXES):
            kind, place = np.nonzero(self.likely[(found & _U(0xFFFFF)).astype(np.int64)])
            hit = found[kind, place]
            at = np.minimum(np.searchsorted(self.terms, hit), len(self.terms) - 1)
            true = self.terms[at] == hit
            np.maximum.at(out[i:j], place[true], self.weights[at[true]])
        return out


EXTRA = ["hits", "strong", "weight", "density", "strong_density", "near_you", "you", "hidden_hits", "hidden_words"]


def _disguised(data: np.ndarray, at: np.ndarray) -> Words:
    """Words with look-alikes between letters or marks inside, rewritten as plain letters."""
    tokens = Words(data, at)
    rows = len(at) - 1
    if not len(tokens.start):
        return Words(data[:0], np.zeros(rows + 1, np.int64))
    marks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~(_LETTER | SPACE)[data], out=marks[1:])
    a, b = tokens.start, tokens.start + tokens.length
    # Marks before the first and after the last letter or look-alike are ordinary punctuation.
    kin = _LETTER | _LEET_BYTE
    kin[ord("!")] = False
    places = np.flatnonzero(kin[data]).astype(np.int32)
    first = np.searchsorted(places, a)
    last = np.searchsorted(places, b) - 1
    # No letter lies between two tokens.
    odd = np.logical_or.reduceat(_LETTER[data], a) & (last > first)
    odd[odd] = marks[places[last[odd]] + 1] > marks[places[first[odd]]]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[a[odd]] += 1
    inside[b[odd]] -= 1
    text = _LEET[data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]]
    keep = _LETTER[text]
    lengths = (b - a)[odd]
    kept = np.add.reduceat(keep, np.cumsum(lengths) - lengths, dtype=np.int64) if odd.any() else np.zeros(0, int)
    # The words one after another, a blank between them.
    text = np.insert(text[keep], np.cumsum(kept), 32)
    ends = np.cumsum(kept + 1)
    count = np.bincount(tokens.row[odd], minlength=rows)
    return Words(text, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])])


def features(data: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(rows x (NAMES + EXTRA)) of a slice of texts."""
    rows = len(at) - 1
    low = _lowered(data)
    words = Words(low, at, space=~_LETTER)
    weight = lexicon.weight(words)
    per_row = lambda w, x: np.bincount(w.row, weights=x, minlength=rows)
    n = np.maximum(np.diff(words.first), 1)
    hashes = words.hashes()
    you = np.isin(hashes, _YOU)
    upto = np.concatenate([[0], np.cumsum(you)])
    hit = np.flatnonzero(weight > 0)
    a = np.maximum(hit - NEAR, words.first[words.row[hit]])
    b = np.minimum(hit + NEAR + 1, words.first[words.row[hit] + 1])
    near = np.bincount(words.row[hit], weights=(upto[b] > upto[a]).astype(float), minlength=rows)
    hidden = _disguised(low, at)
    found = lexicon.weight(hidden)
    hits, strong = per_row(words, (weight > 0).astype(float)), per_row(words, (weight >= 3).astype(float))
    extra = np.column_stack([
        hits, strong, per_row(words, weight), np.log1p(1000 * hits / n), np.log1p(1000 * strong / n), near,
        np.log1p(1000 * per_row(words, you.astype(float)) / n), per_row(hidden, (found >= 3).astype(float)),
        np.log1p(1000 * np.diff(hidden.first) / n),
    ])
    return np.column_stack([profile(data, at), extra])


def _term_counts(texts: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(term, n0, n1): groups of near copies with the term, of each half; ``among``: ascending hashes to keep to."""

    def run(batches):
        for batch in batches:
            half = batch.column(1).to_numpy(zero_copy_only=False)
            for row, end, data, at in text_slices(batch.column(0)):
                whole, begin = shingles(Words(data, at), 3)
                words = Words(_lowered(data), at, space=~_LETTER)
                found = _terms(words)
                for i in range(end - row):
                    mine = np.unique(found[:, words.first[i] : words.first[i + 1]])
                    mine = mine[mine != 0]
                    if among is not None:
                        at_ = np.minimum(np.searchsorted(among, mine), max(len(among) - 1, 0))
                        mine = mine[among[at_] == mine] if len(among) else mine[:0]
                    if len(mine):
                        group = whole[begin[i] : begin[i + 1]].min() if begin[i + 1] > begin[i] else _U(0)
                        yield mine.view(np.int64), np.full(len(mine), group.astype(np.int64)), np.full(len(mine), half[row + i], np.int32)

    def batched(batches):
        """The texts' terms, some hundred thousand a batch."""
        held, size = [], 0
        for part in run(batches):
            held.append(part)
            size += len(part[0])
            if size >= 300_000:
                yield _columns(held)
                held, size = [], 0
        if held:
            yield _columns(held)

    def _columns(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["term", "near", "half"])

    # A term and its group of near copies; the same pair counts once in a half.
    pairs = texts.select("text", "half").mapInArrow(batched, "term long, near long, half int").distinct()
    return pairs.groupBy("term").agg(*(F.sum((F.col("half") == h).cast("int")).alias(f"n{h}") for h in (0, 1)))


def _lexicons(sample: DataFrame) -> list[Lexicon]:
    """Of the first half, of the second, and of both; ``sample``: (key, text, label, half).

    Terms of several toxic texts first; the other texts are asked for those alone.
    """
    toxic = _term_counts(sample.where("label = 1")).where(F.col("n0") + F.col("n1") >= LEAST_TEXTS).toPandas()
    term = toxic["term"].to_numpy(np.int64).view(_U)
    order = np.argsort(term)
    term, toxic = term[order], toxic.iloc[order]
    other = _term_counts(sample.where("label = 0"), term).toPandas()
    at = np.searchsorted(term, other["term"].to_numpy(np.int64).view(_U))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n1 = sum(toxic[f"n{h}"].to_numpy(float) for h in halves)
        n0 = np.zeros(len(term))
        n0[at] = sum(other[f"n{h}"].to_numpy(float) for h in halves)
        good = (n1 >= LEAST_TEXTS) & ((n1 + 0.5) / (n1 + n0 + 1) >= LEAST_SHARE)
        out.append(Lexicon(term[good], np.log((n1 + 0.5) / (n0 + 0.5))[good]))
    return out


class Model:
    def __init__(self, lexicon: Lexicon, trees=None, calibration=None, base: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def probability(self, rows: DataFrame) -> DataFrame:
        """``rows`` (..., features array) with ``score``."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.base)).drop("features")
        raw = self.trees.transform(_vectors(rows)).withColumn("raw", vector_to_array("probability")[1])
        out = self.calibration.transform(raw.drop("prediction")) if self.calibration else raw.drop("prediction").withColumn("prediction", F.col("raw"))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        return out.withColumn("score", score).drop("features", "vector", "rawPrediction", "probability", "prediction", "raw")


def _vectors(rows: DataFrame) -> DataFrame:
    names = [f"f{i}" for i in range(len(NAMES) + len(EXTRA))]
    flat = rows.select("*", *(F.col("features")[i].alias(c) for i, c in enumerate(names)))
    return VectorAssembler(inputCols=names, outputCol="vector").transform(flat).drop(*names)


def _list(found: np.ndarray) -> pa.Array:
    ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    sample = training(docs, labels, label, text, key, rows)
    sample = stage(sample.withColumn("half", F.pmod(F.xxhash64("key"), F.lit(2)).cast("int")), "labelled")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(Lexicon(np.zeros(0, _U), np.zeros(0)), base=float(1 in counts))
    first, second, both = _lexicons(sample)

    def run(batches):
        for batch in batches:
            half = batch.column(3).to_numpy(zero_copy_only=False)
            for row, end, data, at in text_slices(batch.column(1)):
                a, b = features(data, at, second), features(data, at, first)
                found = np.where((half[row:end] == 0)[:, None], a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], batch.column(2)[row:end], _list(found)], ["key", "label", "features"])

    known = sample.select("key", "text", "label", "half").mapInArrow(run, f"key {dict(sample.dtypes)['key']}, label int, features array<double>")
    known = known.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(5)))
    # At most ``rows`` short rows: the trees' many small passes take a few tasks each.
    known = stage(known.withColumn("label", F.col("label").cast("double")), "features").coalesce(6)
    learn, check = known.where("fold > 0"), known.where("fold = 0")
    kinds = learn.select("label").distinct().count(), check.select("label").distinct().count()
    if kinds[0] < 2:
        return Model(both, base=counts.get(1, 0) / sum(counts.values()))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.3, seed=1).fit(_vectors(learn))
    calibration = None
    if kinds[1] == 2:
        raw = trees.transform(_vectors(check)).select("label", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    return Model(both, trees, calibration)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) for every row."""
    lexicon = model.lexicon

    def run(batches):
        for batch in batches:
            for row, end, data, at in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], _list(features(data, at, lexicon))], ["key", "features"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return model.probability(given.mapInArrow(run, f"key {dict(given.dtypes)['key']}, features array<double>"))


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
