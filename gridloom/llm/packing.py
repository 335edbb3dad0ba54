"""Token-ID output: documents encoded by a public tokenizer and packed into rows of fixed length.

Each task encodes its documents in turn and packs them in buffers of about BUFFER_TOKENS tokens, so
its memory is bounded and nothing is shuffled.  A document longer than a row is split losslessly:
full rows first, and a rest that is packed like any other segment.  Segments are packed by
best-fit-decreasing: longest first, each into the open row with the least room that still takes it,
found in a segment tree over capacities (a leaf for every possible room, holding the open rows with
that much room); if none takes it, a new row is opened.

A packed row has its ids as little-endian integers of two bytes (four if the vocabulary needs
them), padded to the row's length, the cumulative lengths of its segments (0 first), the positions
at which position ids start again at 0, and where each segment comes from (doc_id, first token).
``matrix`` and ``position_ids`` turn rows into arrays, ``write`` stores them as Parquet in the shared
store, and ``unpack`` gives back every document's ids.

Defined results: every document ends with the end token, so a null or empty text is the end token
alone, and none is lost.  Text that looks like a special token is ordinary text.  Repeated rows are
packed as often as they stand in the table; a null doc_id stays null.  Row numbers are unique and the
same on every run over the same files.  No rows in, no rows out.  Other columns are not read.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.registry import query, table

ROW_TOKENS = 2048
BUFFER_TOKENS = 1 << 20
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
END_TOKEN = 50256

PACKED = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{key}>, doc_offsets array<int>"


class Capacities:
    """Open rows by the room they have left; the least room that takes a length, in log steps.

    A segment tree of counts over the rooms 0..size, stored by level in one list.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(row, room) of an open row with the least room of at least ``length``; it is taken out."""
        room = self._first(length)
        if room is None:
            return None
        self._change(room, -1)
        return self.rows[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def _first(self, least: int) -> int | None:
        """Smallest room of at least ``least`` with an open row."""
        count, at = self.count, least + self.leaves
        if count[at]:
            return least
        # Up until a right-hand neighbour has rows, then down to its first leaf.
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of segment numbers: best fit, longest segments first, equal ones in order."""
    open_rows, rows = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[i])
        if found is None:
            found = len(rows), size
            rows.append([])
        row, room = found
        rows[row].append(i)
        if room > lengths[i]:
            open_rows.add(row, room - lengths[i])
    return rows


def pack(docs: list[tuple[object, np.ndarray]], size: int, pad: int, kind: np.dtype) -> Iterator[tuple]:
    """Packed rows (ids, tokens, cumulative lengths, resets, doc ids, offsets) of encoded documents."""
    whose, start, length = [], [], []
    for n, (_, ids) in enumerate(docs):
        for a in range(0, len(ids), size):
            whose.append(n)
            start.append(a)
            length.append(min(size, len(ids) - a))
    for row in best_fit(length, size):
        ends = np.cumsum([0, *(length[i] for i in row)])
        ids = np.full(size, pad, kind)
        for i, a, b in zip(row, ends[:-1], ends[1:], strict=True):
            ids[a:b] = docs[whose[i]][1][start[i] : start[i] + length[i]]
        yield ids.tobytes(), int(ends[-1]), ends.tolist(), ends[:-1].tolist(), [docs[whose[i]][0] for i in row], [start[i] for i in row]


def load_ranks(folder: str, vocabulary: str) -> tuple[dict[bytes, int], str]:
    """Token ranks of a vocabulary file, and the pattern that cuts text before merging."""
    spec = importlib.util.spec_from_file_location("public_tokenizers_at", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    lines = Path(folder, vocabulary).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}, module.PATTERN


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    row_tokens: int = ROW_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    end_token: int = END_TOKEN,
) -> DataFrame:
    """Packed rows (PACKED) of all documents; ``folder`` holds the vocabulary on every machine."""
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = dict(given.dtypes)["key"]
    given_type = given.schema["key"].dataType

    def run(batches):
        import tiktoken
        from pyspark.sql.pandas.types import to_arrow_type

        ranks, pattern = load_ranks(folder, vocabulary)
        coder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        wide = np.dtype("<u2") if max(end_token, max(ranks.values())) < 1 << 16 else np.dtype("<u4")
        task, made = TaskContext.get().partitionId() << 32, 0
        types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(to_arrow_type(given_type)), pa.list_(pa.int32())]
        names = [part.split()[0] for part in PACKED.split(", ")]

        def packed(held):
            nonlocal made
            rows = []
            for row in pack(held, row_tokens, end_token, wide):
                rows.append((task + made, *row))
                made += 1
            for a in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 1024], strict=True), types, strict=True)], names)

        held, tokens = [], 0
        for batch in batches:
            for i, whole in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(np.asarray(coder.encode_to_numpy(whole.as_py() or "", disallowed_special=()), wide), wide.type(end_token))
                held.append((i.as_py(), ids))
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from packed(held)
                    held, tokens = [], 0
        if held:
            yield from packed(held)

    return given.mapInArrow(run, PACKED.format(key=kind))


def write(packed: DataFrame, path: str) -> None:
    """Store packed rows; their order in a file is that of packing."""
    packed.write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes], row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Id matrix (rows x row_tokens) of stored rows; the width of an id follows from their size."""
    kind = "<u2" if not ids or len(ids[0]) == 2 * row_tokens else "<u4"
    return np.frombuffer(b"".join(ids), kind).reshape(len(ids), row_tokens)


def position_ids(resets: list[int], n_tokens: int, row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Position of each token in its segment; 0 in the padding."""
    out = np.zeros(row_tokens, np.int32)
    for a, b in zip(resets, [*resets[1:], n_tokens], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def unpack(rows, row_tokens: int = ROW_TOKENS) -> dict:
    """Ids of every document (without its end token) from collected packed rows of ``row_tokens``; keys must be unique."""
    parts: dict = {}
    for r in rows:
        ids = matrix([bytes(r["ids"])], row_tokens)[0]
        for doc, offset, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            parts.setdefault(doc, {})[offset] = ids[a:b]
    return {doc: np.concatenate([p[o] for o in sorted(p)])[:-1].tolist() for doc, p in parts.items()}


@query("op4_token_packing")
def token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
