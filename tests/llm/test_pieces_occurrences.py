"""Merge-dropout is drawn for each occurrence of a word, and op8 decodes what it has encoded."""

import hashlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

from gridloom.llm import pieces
from gridloom.llm.bytetext import text_slices
from gridloom.llm.queries import QUERIES


def test_occurrences_copies_and_documents_differ(make_docs):
    text = " ".join(["international considerations of neighbourhood"] * 40)
    docs = make_docs([(1, text), (2, text), (3, text), (3, text), (3, text), (None, text)])
    found = [(r.doc_id, tuple(r.ids)) for r in pieces.encode(docs, copies=True).collect()]
    assert len({ids for _, ids in found}) == 6
    assert sorted(found, key=str) == sorted(((r.doc_id, tuple(r.ids)) for r in pieces.encode(docs.repartition(5), copies=True).collect()), key=str)
    # Without numbers, only rows that repeat key and text are alike.
    assert len({tuple(r.ids) for r in pieces.encode(docs).collect()}) == 4
    vocabulary = pieces.Vocabulary.load(str(Path(pieces.TOKENIZERS, pieces.MODEL)))
    forms = defaultdict(int)
    for word in "".join(vocabulary.pieces[i] + "|" for i in found[0][1]).split("|" + pieces.SPACE + "international")[1:]:
        forms[word] += 1
    assert len(forms) > 5


def test_occurrences_agree_with_heap():
    vocabulary = pieces.Vocabulary.load(str(Path(pieces.TOKENIZERS, pieces.MODEL)))
    rng = np.random.default_rng(3)
    words = ["of", "the", "considerations", "internationalisation", "x" * 33, "Donaudampfschifffahrtsgesellschaft", "y" * 70, "naïve", " ", "日本語"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(6)] + ["", " a  b "]
    docs = rng.integers(0, 1 << 63, len(texts)).astype(np.uint64)
    for dropout in (0.05, 0.4, 1.0):
        coder = pieces.Coder(vocabulary, 7, dropout)
        ((_, _, data, at),) = text_slices(pa.array(texts), 1 << 30)
        ids, ends = coder.encode_slice(data, at, docs)
        found = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert found == [coder.encode(t, d) for t, d in zip(texts, docs.tolist(), strict=True)]
        assert [coder.decode(f) for f in found] == texts
        assert coder.decode_lists(pa.array([None, *found], pa.list_(pa.int32()))).to_pylist() == [None, *texts]


def test_query_decodes(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op8_sentencepiece"](spark, sf_dir).collect():
        assert r.decoded_sha256 == (None if texts[r.doc_id] is None else hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
