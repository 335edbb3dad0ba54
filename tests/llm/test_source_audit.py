"""Source divergence against plain loops; clashing digests, small tiles and small blocks change nothing."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import sourceaudit
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOW))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        q, p = shares(total), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            near = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, kind, item.decode(), -v, i) for kind, found in (("pair", far), ("term", near)) for i, (v, item) in enumerate(found, 1)}
    return out


def texts():
    words = "alpha Beta gämma δelta eps ζ a b c É é ﬀ x1y".split()
    rows = [(i, " ".join(words[j % len(words)] for j in range(i, i * 3 + 2, 1 + i % 4)), ["en", "de", None][i % 3], ["s1", "s2", None, "s3", ""][i % 5]) for i in range(60)]
    long = " ".join(f"{'uvwxyz'[i % 6]}{'abc'[i % 3]}" for i in range(40_000))
    return [*rows, (60, None, "en", "s9"), (61, "", "xx", "s1"), (62, "only one here", "yy", "s1"), (62, "only one here", "yy", "s1"), (None, long, "en", "s1"), (63, "  12 _ 3", "xx", "s2")]


def rows_of(found):
    return {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in found.collect()}


@pytest.fixture(scope="module")
def docs(make_docs):
    return make_docs(texts())


@pytest.mark.parametrize("least, top", [(3, 4), (1, 1000)])
def test_divergence_by_plain_loops(docs, least, top):
    found = sourceaudit.divergence(docs, least, top)
    assert rows_of(found) == brute(texts(), least, top) and found.count() == len(rows_of(found))


def test_clashing_digests_are_split(docs):
    audit = sourceaudit.Audit(docs, 3, hashed=lambda terms: np.array([len(t) % 3 for t in terms.to_pylist()], np.int64))
    for found, part in ((audit.pairs(), "pair"), (audit.terms(4), "term")):
        assert rows_of(found.withColumn("part", F.lit(part))) == {r for r in brute(texts(), 3, 4) if r[2] == part}
    assert audit.cells.where("split <> ''").count() > 0


def test_digests_follow_the_string_alone():
    words = ["a", "é", "ab", "ba", "a" * 300, "b", "a"]
    found = sourceaudit.digests(pa.array(words))
    assert found[0] == found[6] and len(set(found)) == 6
    assert list(sourceaudit.digests(pa.array(words).slice(2, 3))) == list(found[2:5]) and len(sourceaudit.digests(pa.array([], pa.string()))) == 0


def test_small_tiles_and_blocks(docs, monkeypatch):
    monkeypatch.setattr(sourceaudit, "BLOCK_TERMS", 2)
    audit = sourceaudit.Audit(docs, 3)
    found = {(r.lang, r.source, "pair", r["item"], r.value, r["rank"]) for r in audit.pairs(tile=2).collect()}
    assert found == {r for r in brute(texts(), 3, 4) if r[2] == "pair"}


def test_empty(docs):
    assert sourceaudit.divergence(docs.limit(0)).count() == 0
    assert rows_of(sourceaudit.divergence(docs, least=1000)) == brute(texts(), 1000, 5)


def test_shares_stay_exact_for_large_counts(spark):
    big = [(9_007_199_254_740_993, 9_107_199_254_740_997), (5, 9_107_199_254_740_997), (7, 7), (333_333_333_333_333, 999_999_999_999_999)]
    rows = spark.createDataFrame(big, "a long, b long").select("a", "b", sourceaudit.scaled_share(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.a // r.b for r in rows)
