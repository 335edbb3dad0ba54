"""Filter audit against plain loops over documents, orders and steps."""

import re
from itertools import permutations

import numpy as np
from gridloom.llm import filteraudit

GAP = re.compile("[\x20\x09-\x0d]+")


def fails(rows):
    out = []
    for i, text, *_ in rows:
        t = text or ""
        w = [x for x in GAP.split(t) if x]
        caps = sum("A" <= c <= "Z" for c in t)
        again = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        out.append({c for c, f in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 2 * len(t), any(c in "#$%&*|" for c in t), again], strict=True) if f})
    return out


def brute(rows, good, toxic):
    failed, out = fails(rows), {}
    parts = [r[3] or "" for r in rows]
    for part in set(parts):
        mine = [(f, r[0] in good, r[0] in toxic) for f, r, p in zip(failed, rows, parts, strict=True) if p == part]
        steps = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for n, c in enumerate(order, 1):
                gone, left = [d for d in left if c in d[0]], [d for d in left if c not in d[0]]
                all_ = [d for d in mine if c in d[0]]
                steps[order, n] = [len(left), len(gone), len(all_) - len(gone), sum(d[0] == {c} for d in mine), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        whole = {c: sum(v[1] for (o, n), v in steps.items() if o[n - 1] == c) for c in "ABCDE"}
        out |= {(part, o, n): (*v, whole[o[n - 1]]) for (o, n), v in steps.items()}
    return out


def test_audit_of_messy_documents(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long, "en", "a"), (2, long, "en", "a"), (2, long, "en", "b"), (2, long, "en", "b"), (None, long, "en", "a"), (3, "a b", "en", None), (4, None, "en", ""), (5, "", None, "a"),
        (6, "x " * 300, "en", "a"), (7, "SHOUT " + long, "en", "b"), (8, "É" + long, "en", "b"), (9, long + " #", "en", "a"), (10, "A" * 4000 + " " + long, "en", "a"), (11, long.upper(), "en", "a"),
        (12, "x|y " * 5, "en", "c"), (13, "x|y " * 5, "en", "c"), (None, None, None, None),
    ]
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (2, 1, None), (6, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (13, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    found = filteraudit.audit(filteraudit.cells(filteraudit.masks(docs), labels), "ABCDE").collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    wanted = brute(rows, {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, x in marks if x == 1 and i is not None})
    assert len(found) == len(got) == 600 * 4 and got == wanted
    assert filteraudit.audit(filteraudit.cells(filteraudit.masks(docs.limit(0)), labels), "ABCDE").count() == 0
    assert {r.good_lost for r in filteraudit.audit(filteraudit.cells(filteraudit.masks(docs)), "ABCDE").collect()} == {0}


def test_survivors_of_every_subset():
    counts = np.random.default_rng(3).integers(0, 9, (7, 16, 3))
    found = filteraudit.survivors(counts, 4)
    for subset in range(16):
        passing = [m for m in range(16) if not m & subset]
        assert (found[:, subset] == counts[:, passing].sum(axis=1)).all()


def test_many_parts(spark):
    rows = spark.range(3000).selectExpr("id AS key", "concat('p', id % 700) AS part", "CAST(id % 8 AS int) AS mask")
    found = filteraudit.audit(filteraudit.cells(rows), "XYZ")
    assert found.count() == 700 * 18
    assert found.where("step = 1").groupBy("filter_order").sum("kept").select("sum(kept)").distinct().collect()[0][0] == 1500
