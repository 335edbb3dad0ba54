"""Dense features of texts, and the labelled rows that classifiers learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.bytetext import BLOCK_BYTES, Words

#: Most labelled rows a classifier is fitted on; the rows with the smallest hashes of their doc_id are taken.
TRAIN_ROWS = 20_000

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": (10,), "space": (9, 11, 12, 13, 32), "stop": b".,;:", "shout": b"!?",
          "symbol": b"#$%&*@^~", "bar": b"|<>{}[]\\/_=+", "quote": b"'\"()-`", "wide": range(128, 256)}
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _bytes in enumerate(_KINDS.values()):
    _CLASS[list(_bytes)] = _i
_N = len(_KINDS) + 1

NAMES = [
    "log_bytes", "log_words", "mean_word", "log_longest", "upper", "digit", "line", "space", "stop", "shout", "symbol", "bar", "quote",
    "wide", "control", "repeat", "variety", "marked", "rank_words",
]


def _kinds(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of each kind in each row, some at a time."""
    rows = len(at) - 1
    counts = np.zeros(rows * _N)
    for a in range(0, len(data), BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, len(data))
        first, last = np.searchsorted(at, [a, b - 1], "right") - 1
        row = np.repeat(np.arange(first, last + 1), np.diff(np.clip(at[first : last + 2], a, b)))
        counts += np.bincount(row * _N + _CLASS[data[a:b]], minlength=rows * _N)
    return counts.reshape(rows, _N)


def profile(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features (rows x NAMES) of a slice of texts; every byte of every text counts."""
    rows = len(at) - 1
    size = np.diff(at)
    counts = _kinds(data, at)
    by = dict(zip([*_KINDS, "control"], counts.T, strict=True))
    words = Words(data, at)
    hashes = words.hashes()
    n = np.diff(words.first)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    ends = data[words.start + words.length - 1] if len(hashes) else np.zeros(0, np.uint8)
    marked = ~np.isin(_CLASS[ends], [0, 1, 2, 5, 10]) if len(hashes) else np.zeros(0, bool)
    per_row = lambda x: np.bincount(words.row, weights=x, minlength=rows)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)], float)
    longest = np.zeros(rows)
    np.maximum.at(longest, words.row, words.length)
    some, letters = np.maximum(n, 1), np.maximum(by["upper"] + by["lower"], 1)
    rate = lambda x, of: np.log1p(100 * x / of)
    bytes_ = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n), per_row(words.length.astype(float)) / some, np.log1p(longest), rate(by["upper"], letters),
        *(rate(by[k], bytes_) for k in ("digit", "line", "space", "stop", "shout", "symbol", "bar", "quote", "wide", "control")),
        rate(per_row(again.astype(float)), some), np.log(np.maximum(distinct, 1)) - 0.8 * np.log(some), rate(per_row(marked.astype(float)), some),
        (n == 0).astype(float),
    ])


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned; a null key has none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, text, label 0/1) of at most ``rows`` labelled rows outside the held-out third.

    Null labels and null keys teach nothing; of a key labelled twice the larger label counts.
    """
    k = F.col(f"`{key}`")
    known = labels.where(F.col(f"`{label}`").isNotNull() & k.isNotNull() & ~held_out(k)).groupBy(k.alias("key"))
    known = known.agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    given = docs.select(k.alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    # At most ``rows`` keys: the texts stay where they are.
    return given.join(F.broadcast(known), "key")
