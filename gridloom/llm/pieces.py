"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is that of a public SentencePiece BPE model with byte fallback.  A text is cut into
words that carry the spaces before them (written as the mark U+2581, one of them put before the
text).  Each word starts as single characters; an agenda holds the candidate merges of neighbours
whose joint piece is in the vocabulary, best score first, leftmost among equals.  A merge that
comes up is skipped with probability ``dropout``: if a hash of (seed, document, the word's number in the
text, word, place, piece) falls below it.  The hash depends on nothing else, so a seed gives the same
segmentation of a document on every run and machine, while other seeds, other documents and other
occurrences of a word give others.  A document is its key and its text; ``copies=True`` also tells
rows that repeat both apart.  Without dropout the pieces are those of the model.

A character outside the vocabulary becomes its UTF-8 bytes, and so does a mark U+2581 that stands in
the text itself: decoding gives back every text exactly.

A slice of texts is worked through at once: its distinct words are found by hash (and compared byte
by byte), the agendas of all of them advance together in NumPy arrays, one candidate of each word a
round, and the ids are laid out by the words' places.  Every occurrence draws for the merges of its
word's agenda; those that skip one go on with the agenda of (word, rounds skipped), which all
occurrences with the same skips share.  Longer words have an agenda for each occurrence.  Very long
words, and texts that contain the mark itself, take the same steps one by one with a heap.

Defined results: a null text has null ids and decodes to null; an empty text has none and decodes to
the empty text.  Other columns are carried by ``encode``, whatever their names.  No rows in, no rows
out.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gridloom.llm.bytetext import BYTE_VALUE, mix, powers, text_slices
from gridloom.llm.registry import query, table
from gridloom.llm.rows import row_hash

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20
LONG_WORD = 64
#: Words up to this length share agendas: one of n characters has less than 3n rounds, a bit of an int64 each.
SHARED_WORD = 20
WIDTHS = (4, 6, 8, 10, 12, 16, SHARED_WORD, 32, LONG_WORD)
SLICE = 2 << 20
SPACE = "▁"
_U = np.uint64
_ALL = (1 << 64) - 1
_NONE = (1 << 31) - 1
_GONE = -(1 << 40)
_WORD = re.compile(" *[^ ]+| +")


@dataclass
class Vocabulary:
    """Pieces in order of id, their scores, and the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: list[float]
    bytes: list[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in size]
        pieces = [model.id_to_piece(i) if ok else "" for i, ok in zip(size, plain, strict=True)]
        return cls(pieces, [model.get_score(i) for i in size], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Merges:
    """Piece made by two neighbouring pieces, as its rank: an open-addressed table of pairs."""

    def __init__(self, pieces: dict[str, int], rank: dict[str, int]):
        pairs = [
            (pieces[piece[:cut]] << 32 | pieces[piece[cut:]], n)
            for piece, n in rank.items()
            for cut in range(1, len(piece))
            if piece[:cut] in pieces and piece[cut:] in pieces
        ]
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int32)
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([r for _, r in pairs], np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(left), none, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo] << 32 | right[todo]
        at = self._slot(keys)
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (found != -1)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Coder:
    """Encodes and decodes with one vocabulary, seed and dropout."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, dropout: float = DROPOUT):
        self.vocabulary = vocabulary
        # Rank of each piece among the merges: the agenda is in this order.
        order = sorted((i for i, p in enumerate(vocabulary.pieces) if p), key=lambda i: (-vocabulary.scores[i], i))
        self.rank = {vocabulary.pieces[i]: n for n, i in enumerate(order)}
        self.of_rank = np.array(order, np.int64)
        self.piece_id = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self.merges = Merges(self.piece_id, self.rank)
        # Code point to its own piece; -1 - code where there is none.
        self.single = -1 - np.arange(0x110000, dtype=np.int64)
        for piece, i in self.piece_id.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        # An ASCII character without a piece is its byte; byte pieces never merge.
        for code in range(128):
            if self.single[code] < 0:
                self.single[code] = vocabulary.bytes[code]
        self.seed, self.below = int(mix(np.array([seed & _ALL], _U))[0]), min(int(dropout * 2**64), _ALL)
        self.mark = [vocabulary.bytes[b] for b in SPACE.encode()]
        self.plain = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for value, i in enumerate(vocabulary.bytes):
            self.plain[i] = bytes([value])

    def _key(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hash of each word under the seed."""
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        terms = mix(codes.astype(_U) + _U(1)) * powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, starts) ^ _U(self.seed))

    def _skipped(self, key: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        h = key ^ (rank.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ (place.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        return mix(h) < _U(self.below)

    @staticmethod
    def _salt(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Hash of an occurrence: its document and the number of the word in the text."""
        return mix(doc ^ mix(number.astype(_U) + _U(1)))

    def word(self, word: str, salt: np.ndarray) -> list[int]:
        """Ids of an occurrence of a word written with marks for spaces, by a heap of candidates."""
        left, get = list(word), self.rank.get
        n = len(left)
        codes = np.array([ord(c) for c in word])
        key = mix(self._key(codes, np.array([0]), np.array([n])) ^ salt)
        agenda = [(r, i, 2) for i in range(n - 1) if (r := get(left[i] + left[i + 1])) is not None]
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            r, i, size = heapq.heappop(agenda)
            a, j = left[i], after[i]
            # A merge of pieces that have since been merged otherwise is out of date.
            if not a or j >= n or len(a) + len(left[j]) != size:
                continue
            if self.below and self._skipped(key, np.array([r]), np.array([i]))[0]:
                continue
            joint = a + left[j]
            left[i], left[j] = joint, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := get(joint + left[j])) is not None:
                    heapq.heappush(agenda, (r, i, len(joint) + len(left[j])))
            k = before[i]
            if k >= 0 and (r := get(left[k] + joint)) is not None:
                heapq.heappush(agenda, (r, k, len(left[k]) + len(joint)))
        out: list[int] = []
        for piece in left:
            if piece:
                found = self.piece_id.get(piece)
                out.extend([self.vocabulary.bytes[b] for b in piece.encode()] if found is None else [found])
        return out

    def encode(self, text: str, doc: int = 0) -> list[int]:
        """Ids of one text of the document ``doc``, word by word."""
        out: list[int] = []
        number = 0
        for n, part in enumerate(text.split(SPACE) if text else []):
            if n:
                out.extend(self.mark)
            for word in _WORD.findall(part if n else " " + part):
                out.extend(self.word(word.replace(" ", SPACE), self._salt(np.array([doc], _U), np.array([number]))))
                number += 1
        return out

    def words(self, codes: np.ndarray, starts: np.ndarray, which: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each form's begin and the end, form of each occurrence) of words given as code points.

        ``which`` and ``salt`` are the word and the hash of each occurrence; a form is one segmentation of a word.
        """
        lengths = np.diff(np.append(starts, len(codes)))
        piece = self.single[codes]
        # Without dropout all occurrences of a word are alike.
        use = which if self.below else np.arange(len(starts))
        key = mix(self._key(codes, starts, lengths)[use] ^ salt) if self.below else np.zeros(len(use), _U)
        size = lengths[use]
        form = np.zeros(len(use), np.int64)
        done: list[np.ndarray] = []
        n = 0

        def grid_of(words: np.ndarray, most: int) -> np.ndarray:
            place = starts[words][:, None] + np.arange(most)
            inside = np.arange(most) < lengths[words][:, None]
            return np.where(inside, piece[np.minimum(place, len(piece) - 1)], _GONE)

        for o in np.flatnonzero(size > LONG_WORD).tolist():
            w = use[o]
            text = "".join(map(chr, codes[starts[w] : starts[w] + lengths[w]].tolist()))
            done.append(np.array([self.word(text, salt[o : o + 1])], np.int64))
            form[o] = n
            n += 1
        least = 0
        for most in WIDTHS:
            mine = np.flatnonzero((size > least) & (size <= most))
            least = most
            if not len(mine):
                continue
            if not self.below or most > SHARED_WORD:
                grid = grid_of(use[mine], most)
                self._merge(grid, key[mine])
                done.append(grid)
                form[mine] = n + np.arange(len(mine))
                n += len(mine)
                continue
            # An agenda is a word and the rounds it skips; the occurrences that have it draw for its later rounds.
            word, agenda = np.unique(use[mine], return_inverse=True)
            skips, since = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
            while len(mine):
                grid = grid_of(word, most)
                rounds = self._merge(grid, skips=skips)
                done.append(grid)
                form[mine] = n + agenda
                n += len(word)
                cut = np.full(len(mine), -1)
                on = np.arange(len(mine))
                for t, (top, at) in enumerate(rounds):
                    on = on[top[agenda[on]] >= 0]
                    draw = on[since[agenda[on]] <= t]
                    mark = agenda[draw]
                    cut[draw[self._skipped(key[mine[draw]], top[mark], at[mark])]] = t
                    on = on[cut[on] < 0]
                again = np.flatnonzero(cut >= 0)
                next_, agenda = np.unique(agenda[again] << 6 | cut[again], return_inverse=True)
                mine, old, since = mine[again], next_ >> 6, next_ & 63
                word, skips = word[old], skips[old] | np.int64(1) << since
                since = since + 1
        many = np.concatenate([(grid != _GONE).sum(1) for grid in done])
        bounds = np.concatenate([[0], np.cumsum(many)])
        ids = np.concatenate([grid[grid != _GONE] for grid in done])
        ids, bounds = self._spelled(ids, bounds)
        return ids, bounds, form if self.below else form[which]

    def _merge(self, grid: np.ndarray, key: np.ndarray | None = None, skips: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Advance the agendas of all words (rows of ``grid``) together, in place.

        In each round every word takes its best candidate: the least rank, the leftmost one.  It is skipped by
        the hash of the row's ``key``, or if ``skips`` has the round's bit; then the candidates (rank, place) of
        all rows are returned for each round, rank -1 where a row has come to its end.
        """
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        n, width = grid.shape
        rank = np.full((n, width), _NONE, np.int32)
        rank[:, :-1] = self.merges.rank(grid[:, :-1].ravel(), grid[:, 1:].ravel(), _NONE).reshape(n, width - 1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int8), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int8), (n, 1))
        rows = np.arange(n)
        live, work = rows, grid
        while len(live):
            best = rank.argmin(1)
            top = rank[rows, best]
            open_ = top < _NONE
            if not open_.all():
                grid[live[~open_]] = work[~open_]
                live, work, rank, after, before, best, top = (x[open_] for x in (live, work, rank, after, before, best, top))
                rows = np.arange(len(live))
                if not len(live):
                    break
            row, at, top = rows, best, top.astype(np.int64)
            if skips is not None:
                rounds.append((np.full(n, -1, np.int32), np.zeros(n, np.int8)))
                rounds[-1][0][live], rounds[-1][1][live] = top, at
            if self.below:
                skip = self._skipped(key[live], top, at) if skips is None else (skips[live] >> np.int64(len(rounds) - 1) & 1).astype(bool)
                rank[row[skip], at[skip]] = _NONE
                row, at, top = row[~skip], at[~skip], top[~skip]
            gone = after[row, at].astype(np.int64)
            work[row, at] = self.of_rank[top]
            work[row, gone] = _GONE
            rank[row, gone] = _NONE
            right = after[row, gone].astype(np.int64)
            after[row, at] = right
            has = right < width
            before[row[has], right[has]] = at[has]
            # New neighbours: the merged piece with the next one, and the one before with it.
            rank[row, at] = _NONE
            r, a, b = row[has], at[has], right[has]
            rank[r, a] = self.merges.rank(work[r, a], work[r, b], _NONE)
            left = before[row, at].astype(np.int64)
            has = left >= 0
            r, a, b = row[has], left[has], at[has]
            rank[r, a] = self.merges.rank(work[r, a], work[r, b], _NONE)
        return rounds

    def _spelled(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their bytes."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, bounds
        spelled = [[self.vocabulary.bytes[b] for b in chr(-1 - i).encode()] for i in ids[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(x) for x in spelled]
        ends = np.concatenate([[0], np.cumsum(times)])
        out = np.repeat(ids, times)
        out[np.repeat(ends[odd], times[odd]) + np.concatenate([np.arange(len(x)) for x in spelled])] = [i for x in spelled for i in x]
        return out, ends[bounds]

    def encode_slice(self, data: np.ndarray, at: np.ndarray, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each row's begin and the end) of a slice of texts as bytes; ``docs`` are hashes of their documents."""
        rows = len(at) - 1
        docs = np.zeros(rows, _U) if docs is None else docs
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        filled = np.flatnonzero(at[:-1] < at[1:])
        begin = np.zeros(len(data), bool)
        begin[1:] = (data[1:] == 32) & (data[:-1] != 32)
        begin[at[filled]] = True
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, len(data)))
        row = np.searchsorted(at, start, "right") - 1
        heads = start == at[row]
        place = np.arange(len(data)) - np.repeat(start, length)
        h = mix(np.add.reduceat(BYTE_VALUE[data] * powers(int(length.max()))[place], start) + length.astype(_U) * _U(2) + heads)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        like = data[np.repeat(start[first][which], length) + place] if (length == length[first][which]).all() else None
        marked = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        if like is None or (like != data).any() or marked.any() or (heads != heads[first][which]).any():
            return self._one_by_one(data, at, docs)
        # The distinct words, one after another, those that begin a row with a space before them.
        size = length[first]
        put = np.cumsum(size) - size
        index = np.arange(size.sum()) - np.repeat(put, size) + np.repeat(start[first], size)
        held = data[index]
        codes = np.frombuffer(held.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.cumsum((held & 0xC0) != 0x80) - 1
        begins = begins[put]
        if begins[-1] >= len(codes) or int(((held & 0xC0) != 0x80).sum()) != len(codes):
            return self._one_by_one(data, at, docs)
        lead = heads[first]
        codes = np.insert(np.where(codes == 32, ord(SPACE), codes), begins[lead], ord(SPACE))
        number = np.arange(len(start)) - np.searchsorted(start, at[:-1])[row]
        ids, bounds, form = self.words(codes, begins + np.cumsum(lead) - lead, which, self._salt(docs[row], number))
        many = np.diff(bounds)[form]
        ends = np.concatenate([[0], np.cumsum(many)])
        out = ids[np.arange(ends[-1]) - np.repeat(ends[:-1] - bounds[:-1][form], many)]
        return out.astype(np.int32), ends[np.searchsorted(start, at)]

    def _one_by_one(self, data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        lists = [np.array(self.encode(t, d), np.int32) for t, d in zip(texts, docs.tolist(), strict=True)]
        return np.concatenate(lists), np.cumsum([0, *map(len, lists)])

    def decode(self, ids) -> str:
        plain = self.plain
        return b"".join([plain[i] for i in ids])[1:].decode("utf-8", "replace") if len(ids) else ""

    def decode_lists(self, lists: pa.Array) -> pa.Array:
        """Texts of an array of lists of ids; a null list gives a null text."""
        at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        pieces = pa.array(self.plain, pa.large_binary()).take(lists.values.slice(at[0], at[-1] - at[0]))
        _, ends, data = pieces.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(pieces) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        # The first piece of a text begins with the mark put before it.
        first = ends[at[:-1] - at[0]][at[:-1] < at[1:]]
        kept = np.delete(raw[: ends[-1]], first)
        bounds = ends[at - at[0]] - np.concatenate([[0], np.cumsum(at[:-1] < at[1:])])
        gone = np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
        out = pa.Array.from_buffers(pa.large_string(), len(lists), [pa.py_buffer(gone), pa.py_buffer(bounds), pa.py_buffer(kept)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.large_string())
        return out


_CODERS: dict[tuple, Coder] = {}


def coder_of(path: str, seed: int, dropout: float) -> Coder:
    """The coder of this worker, made once; one seed at a time is kept."""
    key = (path, seed, dropout)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(Vocabulary.load(path), seed, dropout)
    return _CODERS[key]


def encode(
    docs: DataFrame,
    text: str = "text",
    seed: int = SEED,
    dropout: float = DROPOUT,
    folder: str = TOKENIZERS,
    model: str = MODEL,
    into: str = "ids",
    key: str = "doc_id",
    copies: bool = False,
) -> DataFrame:
    """``docs`` with the array column ``into``: the ids of each text; an old column of that name goes.

    ``copies`` numbers the rows that repeat ``key`` and text, so that each has draws of its own.
    """
    held = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != into.lower()))
    place, path = held.columns.index(text), str(Path(folder, model))
    schema = T.StructType([*held.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    doc = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    if copies:
        doc = F.xxhash64(doc, F.row_number().over(Window.partitionBy(doc).orderBy(row_hash(held))))
    held = held.select("*", doc.alias("doc" + "_" * max(map(len, held.columns))))

    def run(batches):
        coder = coder_of(path, seed, dropout)
        for batch in batches:
            docs_of = batch.column(batch.num_columns - 1).to_numpy().view(_U)
            batch = batch.select(range(batch.num_columns - 1))
            for row, end, data, at in text_slices(batch.column(place), SLICE):
                ids, ends = coder.encode_slice(data, at, docs_of[row:end])
                part = batch.slice(row, end - row)
                gone = pa.array(part.column(place).is_null().to_numpy(zero_copy_only=False))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=gone)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, into])

    return held.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", folder: str = TOKENIZERS, model: str = MODEL, into: str = "decoded") -> DataFrame:
    """``rows`` with the text that each array of ids stands for."""
    held = rows.select(*(f"`{c}`" for c in rows.columns if c.lower() != into.lower()))
    place, path = held.columns.index(ids), str(Path(folder, model))
    schema = T.StructType([*held.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        coder = coder_of(path, 0, 0.0)
        for batch in batches:
            for row, end in _list_slices(batch.column(place)):
                part = batch.slice(row, end - row)
                texts = coder.decode_lists(part.column(place)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, into])

    return held.mapInArrow(run, schema)


def _list_slices(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of slices that end with the row that reaches SLICE ids."""
    if not len(lists):
        return
    at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    row = 0
    while row < len(lists):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        yield row, end
        row = end


@query("op8_sentencepiece")
def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = encode(docs.select("doc_id", "text"))
    n_chars, n_pieces = F.char_length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_pieces")
    back = decode(out.select("doc_id", n_chars, n_pieces, "ids"))
    return back.select("doc_id", "n_chars", "n_pieces", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
