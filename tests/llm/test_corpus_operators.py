"""Operators over documents: edge cases, brute force, round trips and held-out accuracy."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck
from gridloom.llm import exact_dedup, fingerprints, jaccard_join, langid, mixing, packing, pieces, quality, toxicity, warc
from gridloom.llm.bytetext import Words, text_slices
from gridloom.llm.components import components
from gridloom.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_sets(rows, k):
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    holders = defaultdict(list)
    for b in ids:
        common = Counter(a for s in sets[b] for a in holders[s])
        for a, n in common.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
        for s in sets[b]:
            holders[s].append(b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(SQL[name]).df()) is None


def test_words_are_those_of_the_pattern():
    texts = ["", "a B c", "  x\ny\tz ", None, "é ü", "one", "\x0bv\x0c"]
    got = []
    for row, end, data, at in text_slices(pa.array(texts), 6):
        w = Words(data, at)
        got += [[bytes(w.data[s : s + n]).decode() for s, n, r in zip(w.start, w.length, w.row, strict=True) if r == k] for k in range(end - row)]
    assert got == [WORD.findall((t or "").translate(LOW)) for t in texts]


def test_exact_dedup_messy(messy):
    found = Counter((r.key, r.keep_key, r.group_size, r.kept) for r in exact_dedup.decisions(messy).collect())
    assert found[(5, 5, 4, True)] == 2 and found[(1, 5, 4, False)] == 1 and found[(None, 5, 4, False)] == 1
    assert found[(2, 3, 3, False)] == 1 and found[(3, 3, 3, True)] == 1
    kept = exact_dedup.deduplicate(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.decisions(messy.limit(0)).count() == 0 and exact_dedup.deduplicate(messy.limit(0)).count() == 0


def test_exact_dedup_tells_clashing_digests_apart(make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.lit("same"))
    found = {r.key: (r.keep_key, r.group_size) for r in exact_dedup.decisions(make_docs([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")])).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_mixing_messy(messy):
    out = mixing.sample(messy).collect()
    assert len(out) == messy.count() and all(0 <= r.copies <= 3 for r in out)
    by = {r.source: (r.source_size, r.target) for r in out}
    assert sum(t for _, t in by.values()) == pytest.approx(sum(s for s, _ in by.values()))
    assert all(t <= 3 * s + 1e-9 for s, t in by.values())
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns and mixed.count() == sum(r.copies for r in out)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(messy).collect()))
    assert mixing.sample(messy.limit(0)).count() == 0 and mixing.mix(messy.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark, make_docs):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", f"s{i % 4}") for i in range(2000)]
    out = mixing.sample(make_docs(rows)).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("took"))
    assert all(abs(r.took / r.t - 1) < 0.01 for r in out.collect())


def test_fingerprints_messy(messy):
    out = fingerprints.with_next(messy)
    rows = out.select("key", "text", "next_text", "sketch", fingerprints.encode(F.col("sketch")).alias("code")).collect()
    assert len(rows) == messy.count() and all(r.next_text is not None for r in rows)
    assert len({r.code for r in rows if r.text == "a b c d e f g h"}) == 1
    assert Counter(r.next_text for r in rows) == Counter(r.text for r in rows)
    last = next(r for r in rows if r.key == 10)
    assert last.next_text in {r.text for r in rows if r.key is None}
    assert {len(r.sketch) for r in rows if not WORD.findall(r.text)} == {0}
    back = out.select(fingerprints.decode(fingerprints.encode(F.col("sketch"))).alias("b"), "sketch").collect()
    assert all(r.b == r.sketch for r in back)
    assert fingerprints.with_next(messy.limit(0)).count() == 0


def test_fingerprints_estimate_and_merge(spark):
    a, b = (" ".join(f"w{i}" for i in r) for r in (range(0, 3000), range(1000, 4000)))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"),
        fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
        fingerprints.distinct_estimate(F.col("a")).alias("n"),
        fingerprints.merge(F.col("a"), F.col("b")).alias("m"),
    ).first()
    assert r.j == pytest.approx(0.5, abs=0.15) and r.c == pytest.approx(0.667, abs=0.2) and r.n == pytest.approx(2996, rel=0.3)
    parts = df.select(F.explode(F.array("a", "b")).alias("s")).withColumn("g", F.lit(1))
    assert fingerprints.merge_groups(parts, ["g"], "s").first().s == r.m


def test_fingerprint_query_edits_texts(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_match_brute_force(spark, make_docs, k, percent):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in rng.integers(0, 4000, 400)]
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for i in range(120):
        n = int(rng.integers(2, 400))
        words = base[:n] if i % 3 else [f"u{x}" for x in rng.integers(0, 9000, n)]
        words = [w if rng.random() > 0.01 * (i % 5) else f"e{i}" for w in words]
        rows.append((i, " ".join(words) + (" " + passage if i % 4 == 0 else "")))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, " ")]
    sets = shingle_sets(rows, k)
    found = {r.key: (r.n_shingles, r.component) for r in jaccard_join.near_duplicates(make_docs(rows), k=k, percent=percent).collect()}
    assert found == {i: (len(sets[i]), c) for i, c in brute_components(sets, percent).items()}


def test_near_duplicates_messy(messy):
    out = jaccard_join.keep_one(messy, k=5, percent=80)
    assert out.columns == messy.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 2, 3, 4, 6, 7, 8, 10, None])
    assert jaccard_join.keep_one(messy.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def held_out_accuracy(rows, labels, predicted):
    mine = [(labels[r.doc_id], r[predicted]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in mine) / len(mine)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf}/labels.parquet").collect()
    for name, label, least in (("op6_quality_classifier", "quality", 0.97), ("op7_toxicity", "toxic", 0.9)):
        rows = QUERIES[name](spark, sf).collect()
        assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
        assert held_out_accuracy(rows, {r.doc_id: r[label] for r in given}, "predicted") >= least
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert held_out_accuracy(QUERIES["op10_language_id"](spark, sf).collect(), langs, "lang_pred") >= 0.97


def test_classifiers_messy(spark, messy):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 0, 1), (5, 1, 0), (5, 0, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for known in (labels, none):
        model = quality.fit(messy, known)
        assert quality.score(messy, model).count() == messy.count() and quality.keep_good(messy, model).columns == messy.columns
        assert toxicity.score(messy, toxicity.fit(messy, known)).where("score between 0 and 1").count() == messy.count()
        assert quality.score(messy.limit(0), model).count() == 0
    model = langid.fit(messy)
    found = {r.key: r.lang_pred for r in langid.predict(messy, model).collect()}
    assert found[2] == found[3] == found[10] == "und" and found[4] in ("en", "fr")
    assert {r.lang_pred for r in langid.predict(messy, langid.fit(messy.limit(0))).collect()} == {"und"}


def test_disguised_words_are_rewritten():
    data = np.frombuffer(b"you 1d!ot p.a.t plain! $$$ x", np.uint8)
    w = toxicity._disguised(data, np.array([0, len(data)]))
    assert [bytes(w.data[s : s + n]).decode() for s, n in zip(w.start, w.length, strict=True)] == ["idiot", "pat"]


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/x y", big, 1), (2, "http://a/2", big, 1), (2, "http://a/2", big, 1), (None, None, big, 1), (3, None, "small\r\n\r\nWARC/1.1 x", 1),
            (4, "u\r\nX: 1", "small\r\n\r\nWARC/1.1 x", 1), (5, "http://b", None, 1), (6, "http://c", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for compression in ("gzip", "none"):
        warc.write(pages, str(tmp_path / compression), compression=compression)
        out = warc.captures(warc.read(spark, str(tmp_path / compression))).collect()
        digest = hashlib.sha1(big.encode()).hexdigest()
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest == digest, r.record_type, r.refers_to) for r in out)
        assert got[(1, 1200, True, "revisit", 2)] == 1 and got[(2, 1200, True, "response", None)] == 2 and got[(None, 1200, True, "revisit", 2)] == 1
        assert got[(3, 19, False, "response", None)] == 1 and got[(5, 0, False, "response", None)] == 1 and sum(got.values()) == 8
        assert all(r.request is not None and len(r.metadata) == 1 for r in out)
        assert {r.page_id: bytes(r.payload).decode() for r in out if r.record_type == "response"}[4] == "small\r\n\r\nWARC/1.1 x"
    warc.write(pages.limit(0), str(tmp_path / "empty"))
    assert warc.captures(warc.read(spark, str(tmp_path / "empty"))).count() == 0


def test_archive_query(spark, sf_dir):
    found = {tuple(r) for r in QUERIES["op3_warc"](spark, sf_dir).collect()}
    assert found == set(duck(sf_dir).execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, request_uri, fetched_bytes, n_metadata FROM ({SQL['op3_warc']})").fetchall())


def naive_best_fit(lengths, size):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rows if r[0] >= lengths[i]]
        row = min(fits, key=lambda r: r[0]) if fits else None
        if row is None:
            rows.append(row := [size, []])
        row[0] -= lengths[i]
        row[1].append(i)
    return sorted(sum(lengths[i] for i in r[1]) for r in rows)


def test_best_fit_fills_rows_as_a_plain_search_does():
    rng = np.random.default_rng(1)
    for size in (1, 7, 64, 100):
        lengths = rng.integers(1, size + 1, 300).tolist()
        rows = packing.best_fit(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(300))
        assert sorted(sum(lengths[i] for i in r) for r in rows) == naive_best_fit(lengths, size)


def test_packing_round_trip(messy):
    rows = packing.pack_documents(messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), row_tokens=64).collect()
    import tiktoken

    ranks, pattern = packing.load_ranks(packing.TOKENIZERS, packing.VOCABULARY)
    coder = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in messy.collect() if r.doc_id is not None}
    assert {d: coder.decode(i) for d, i in packing.unpack(rows, 64).items()} == texts
    assert len({r.pack_id for r in rows}) == len(rows) and packing.matrix([bytes(r.ids) for r in rows], 64).shape == (len(rows), 64)
    assert packing.position_ids([0, 3], 5, 8).tolist() == [0, 1, 2, 0, 1, 0, 0, 0]
    assert packing.pack_documents(messy.limit(0)).count() == 0


def test_pieces_decode_losslessly(messy):
    ids = pieces.encode(messy, seed=4, dropout=0.3)
    back = pieces.decode(ids)
    assert all(r.decoded == r.text for r in back.collect()) and back.columns == [*messy.columns, "ids", "decoded"]
    assert pieces.encode(messy.limit(0)).count() == 0


def test_pieces_agree_with_heap_and_library(spark, sf_dir):
    import sentencepiece

    path = str(Path(pieces.TOKENIZERS, pieces.MODEL))
    vocabulary = pieces.Vocabulary.load(path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    seen = set()
    for dropout, seed in ((0.0, 1), (0.2, 1), (0.2, 2), (0.2, 1)):
        coder = pieces.Coder(vocabulary, seed, dropout)
        ((_, _, data, at),) = text_slices(pa.array(texts), 1 << 30)
        ids, ends = coder.encode_slice(data, at)
        found = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert found[:10] == [coder.encode(t) for t in texts[:10]] and [coder.decode(f) for f in found] == texts
        if not dropout:
            assert found == [model.encode(t) for t in texts]
        seen.add(str(found))
    assert len(seen) == 3


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good, distinct, content, mixed, last = (f for _, f in corpus_pipeline.STAGES)
    kept = good(spark, docs, sf_dir).cache()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in QUERIES["op6_quality_classifier"](spark, sf_dir).collect() if r.predicted}
    one = distinct(spark, kept, sf_dir).cache()
    by_text = defaultdict(list)
    for r in kept.collect():
        by_text[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(max(v) for v in by_text.values())
    near = content(spark, one, sf_dir).cache()
    roots = brute_components(shingle_sets([(r.doc_id, r.text) for r in one.collect()], 5), 80)
    assert {r.doc_id for r in near.collect()} == set(roots.values())
    mix = mixed(spark, near, sf_dir)
    out = last(spark, mix, sf_dir)
    assert mix.columns == docs.columns and out.columns == [*docs.columns, "ids"]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(r.doc_id for r in out.collect())
