"""Quality classifier: Bradley-Terry ranking of documents.

A document's strength is a weighted sum of features of its whole text.  The weights are learned
from preference pairs: a good document is preferred to a bad one with probability
1 / (1 + exp(-(difference of their strengths))), and the logistic loss over feature differences is
minimised (Newton steps with a small ridge).  The threshold is a quantile of the training
documents' strengths, at the share of bad ones among them; the score is the probability that a
document is preferred to one at the threshold.

It is fitted on at most TRAIN_ROWS labelled rows (see ``features.training``) and PAIRS preference
pairs; every document is scored, over its whole text.

Defined results: a null text is scored as the empty text.  Without pairs (no labels, or one kind
only) every score is 0.5.  Other columns are neither read nor changed.  No rows in, no rows out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.bytetext import text_slices
from gridloom.llm.features import NAMES, TRAIN_ROWS, held_out, profile, training
from gridloom.llm.registry import query, table

PAIRS = 200_000


@dataclass
class Ranking:
    """Strength = weights . (features - middle) / spread; ``threshold`` separates good from bad."""

    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    threshold: float

    def scores(self, column: pa.Array) -> np.ndarray:
        found = [self.strength(profile(data, at)) for _, _, data, at in text_slices(column)]
        raw = np.concatenate(found) if found else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -40, 40)))

    def strength(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.middle) / self.spread, -8, 8) @ self.weights


def learn(features: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 1) -> Ranking:
    """Ranking from labelled features; the order of the rows does not matter."""
    order = np.lexsort([*features.T, label])
    features, label = features[order], label[order]
    middle = features.mean(0) if len(label) else np.zeros(len(NAMES))
    spread = np.maximum(features.std(0), 1e-3) if len(label) else np.ones(len(NAMES))
    model = Ranking(np.zeros(len(NAMES)), middle, spread, 0.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    x = np.clip((features - middle) / spread, -8, 8)
    draw = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    over = x[draw.choice(good, n)] - x[draw.choice(bad, n)]
    for _ in range(25):
        lose = 1 / (1 + np.exp(np.clip(over @ model.weights, -40, 40)))
        slope = -(over * lose[:, None]).mean(0) + ridge * model.weights
        bend = (over * (lose * (1 - lose))[:, None]).T @ over / n + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-6:
            break
    model.threshold = float(np.quantile(x @ model.weights, (label == 0).mean()))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Ranking:
    def features(batches):
        for batch in batches:
            for row, end, data, at in text_slices(batch.column(1)):
                found = profile(data, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row:end], pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))],
                    ["label", "features"],
                )

    rows_ = training(docs, labels, label, text, key, rows).select("label", "text")
    known = rows_.mapInArrow(features, "label int, features array<double>").toPandas()
    x = np.array(known["features"].tolist(), float).reshape(len(known), len(NAMES))
    return learn(x, known["label"].to_numpy(int))


def score(docs: DataFrame, model: Ranking, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) for every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["key", "score"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(run, f"key {dict(given.dtypes)['key']}, score double")


def keep_good(docs: DataFrame, model: Ranking, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``least`` or more."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(place)) >= least))

    return docs.mapInArrow(run, docs.schema)


@query("op6_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
