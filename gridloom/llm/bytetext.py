"""Whole Arrow columns of text as NumPy arrays of words: boundaries and 64-bit hashes, never sampled or cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Bytes of texts worked on at once, and those of them that have 64-bit terms at a time.
SLICE_BYTES, BLOCK_BYTES = 512 << 10, 256 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _STEP)
_POWERS = [np.ones(1, _U)]


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd constant, kept for the next call."""
    if len(_POWERS[0]) < n:
        row = np.full(max(n, 256), _U(0xD6E8FEB86659FD93))
        row[0] = 1
        _POWERS[0] = np.multiply.accumulate(row)
    return _POWERS[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null row is empty.

    A slice ends with the row that reaches ``limit`` bytes, so temporary arrays stay small
    however many long texts a batch holds.
    """
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: start, length, row, and 64-bit hash of the bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = True, space: np.ndarray = SPACE):
        self.data = LOWER[data] if lower else data
        self.at = at
        inside = ~space[data]
        firsts = at[:-1][at[:-1] < at[1:]]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[firsts] = inside[firsts]
        self.start = np.flatnonzero(begin)
        edge = ~inside
        edge[firsts] = True
        edges = np.append(np.flatnonzero(edge), len(data))
        self.length = edges[np.searchsorted(edges, self.start, "right")] - self.start
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(at)))  # of each row, and the end
        self._inside = inside

    def _blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first word, word after the last, terms of their bytes, where each word begins in these).

        Some BLOCK_BYTES at a time, so that what is kept for each byte stays small however long a text is.
        """
        power = powers(int(self.length.max())) if len(self.start) else _POWERS[0]
        ends = np.cumsum(self.length)
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - self.length[i] + BLOCK_BYTES, "right")))
            part = slice(self.start[i], self.start[j - 1] + self.length[j - 1])
            length = self.length[i:j]
            head = np.cumsum(length) - length
            place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(head.astype(np.int32), length)
            yield i, j, BYTE_VALUE[self.data[part][self._inside[part]]] * power[place], head
            i = j

    def hashes(self) -> np.ndarray:
        out = np.zeros(len(self.start), _U)
        for i, j, terms, head in self._blocks():
            out[i:j] = mix(np.add.reduceat(terms, head) + self.length[i:j].astype(_U) * _STEP)
        return out

    def beginnings(self, lengths: range) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, word after the last, hashes): a row for the whole words, then one for the first n bytes
        of each word for every n, 0 where the word is not longer than n."""
        for i, j, terms, head in self._blocks():
            length = self.length[i:j]
            upto = np.concatenate([np.zeros(1, _U), np.cumsum(terms)])
            out = np.zeros((1 + len(lengths), j - i), _U)
            out[0] = mix(upto[head + length] - upto[head] + length.astype(_U) * _STEP)
            for row, n in zip(out[1:], lengths, strict=True):
                long = np.flatnonzero(length > n)
                kind = _U((n * int(_STEP) ^ 0x5851F42D4C957F2D) & (1 << 64) - 1)
                row[long] = mix(upto[head[long] + n] - upto[head[long]] ^ kind)
            yield i, j, out


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words inside a row, and where each row's shingles begin.

    A row with 1 to k-1 words has one shingle, its whole sequence; a row without words has none.
    """
    h = words.hashes()
    count = np.diff(words.first)
    factor = mix(np.arange(1, k + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(made)])
    place = np.repeat(words.first[:-1] - begin[:-1], made) + np.arange(begin[-1])
    width = np.repeat(np.minimum(count, k), made)
    padded = np.append(h, np.zeros(k, _U))
    total = width.astype(_U)
    for i in range(k):
        total = total + np.where(i < width, padded[place + i] * factor[i], _U(0))
    return mix(total), begin
