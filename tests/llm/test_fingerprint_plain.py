"""The fingerprint query against plain loops; ranges of keys that many rows have."""

import hashlib
import re
import struct

import gridloom.llm.fingerprints as fp
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def chained(values):
    """Hash of several longs, each seeded with the one before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed)
    return seed


def plain_sketch(text, k=128, width=5):
    words = [struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text)]
    if len(words) >= width:
        found = {chained(words[i : i + width]) for i in range(len(words) - width + 1)}
    else:
        found = {signed_few(words)} if words else set()
    return sorted(h >> 16 for h in found)[:k] if found else []


def signed_few(words):
    """Hash of an array and its length, as Spark does: elements in turn, then the int."""
    return chained([*words, struct.pack("<i", len(words))])


def plain_likeness(a, b, k=128):
    if not a and not b:
        return 1.0
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / max(1, len(union))


def test_query_by_plain_loops(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in fp.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    found = {r.doc_id: r for r in fp.edited_fingerprints(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    sketches = [plain_sketch(t) for _, t in docs]
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, changed = sketches[i], sketches[(i + 1) % len(docs)], plain_sketch(edited)
        row = found[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == "".join(f"{h:012X}" for h in own) and row.edited_fingerprint == "".join(f"{h:012X}" for h in changed)
        assert row.near_edited == pytest.approx(plain_likeness(own, changed)) and row.near_next == pytest.approx(plain_likeness(own, other))


@pytest.mark.parametrize("range_rows", [4, 16, 4096])
def test_a_key_of_many_rows_is_cut(make_docs, monkeypatch, range_rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", range_rows)
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(40)] + [(i, f"text {i}") for i in range(60)]
    docs = make_docs(rows)
    next_of = {(r.key, r.text): r.next_text for r in fp.with_next(docs).collect()}
    tied = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    ordered = [(r.doc_id, r.text) for r in tied.orderBy(F.col("doc_id").asc_nulls_first(), "t").collect()]
    assert next_of == {a: b[1] for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    ranges = fp.in_ranges(tied.withColumnRenamed("doc_id", "key"), "key", "t").groupBy("range", "slot", "part").count()
    assert ranges.agg(F.max("count")).first()[0] <= 4 * range_rows


def test_keys_are_numbers(spark):
    with pytest.raises(ValueError, match="number"):
        fp.with_next(spark.createDataFrame([("a", "b c")], "doc_id string, text string"))


def test_no_rows_and_no_keys(make_docs):
    assert fp.with_next(make_docs([(1, "a")]).where("doc_id > 1")).count() == 0
    assert {r.next_text for r in fp.with_next(make_docs([(None, "a"), (None, "b")])).collect()} == {"a", "b"}
