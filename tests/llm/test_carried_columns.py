"""Columns without an order, wide ids, captures out of their nested records, bounded archive files."""

from collections import Counter

import numpy as np
import pytest
from gridloom.llm import exact_dedup, mixing, packing, pieces, warc
from gridloom.llm.queries import QUERIES
from gridloom.llm.warc import parse, unpacked
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def mapped(make_docs):
    rows = [(1, "a b", "en", "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s"), (3, "c d e", "de", "t"), (3, "c d e", "de", "t"), (None, None, None, None), (4, "", "en", "t")]
    return make_docs(rows).withColumn("facts", F.create_map(F.lit("k"), F.col("doc_id")))


def test_exact_dedup_carries_a_map(mapped):
    found = exact_dedup.deduplicate(mapped)
    assert found.columns == mapped.columns
    got = {(r.doc_id, r.text): r.facts for r in found.collect()}
    assert got == {(2, "a b"): {"k": 2}, (3, "c d e"): {"k": 3}, (4, ""): {"k": 4}}


def test_mixing_and_encoding_carry_a_map(mapped):
    mixed = mixing.mix(mapped)
    assert mixed.columns == mapped.columns
    assert all(r.facts == {"k": r.doc_id} for r in mixed.collect())
    coded = pieces.encode(mapped, copies=True)
    assert coded.columns == [*mapped.columns, "ids"] and coded.count() == 7


def test_ids_of_four_bytes_come_back():
    held = [(i, np.array([70_000 + i, 70_001, 5, 9], "<u4")) for i in range(9)] + [(99, np.arange(80_000, 80_050, dtype="<u4"))]
    names = [part.split()[0] for part in packing.PACKED.split(", ")][1:]
    rows = [dict(zip(names, r, strict=True)) for r in packing.pack(held, 16, 9, np.dtype("<u4"))]
    assert packing.unpack(rows, 16) == {k: ids[:-1].tolist() for k, ids in held}


def test_nested_records_tell_the_request_and_the_size(spark, sf_dir):
    found = QUERIES["op3_warc"](spark, sf_dir)
    rows = found.collect()
    assert all(r.fetched_bytes == r.payload_bytes and r.n_metadata == 1 and r.request_uri for r in rows)
    # Requests and metadata are joined to their captures by concurrent-to identifiers.
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") >= 3 and "concurrent_to" in text and "revisit" in text


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 8000)
    sizes = [10] * 30 + [900] * 30 + [3000] * 8 + [20_000] * 2
    pages = spark.createDataFrame([(i, f"http://a/{i}", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write(pages, path, least=10**6)
    held = []
    for f in (tmp_path / "w").glob("*.gz"):
        bodies = [len(body) for head, body in parse(unpacked(f.read_bytes())) if head["warc-type"] == ["response"]]
        held += bodies
        assert sum(bodies) <= 8000 + 8 * 200 or len(bodies) == 1
    assert len(held) == 70
    out = warc.facts(warc.captures(warc.read(spark, path))).collect()
    assert Counter(r.payload_bytes for r in out) == Counter(n + len(str(i)) for i, n in enumerate(sizes))
    assert {r.request_uri for r in out} == {f"http://a/{i}" for i in range(70)}
