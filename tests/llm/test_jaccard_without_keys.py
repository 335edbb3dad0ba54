"""Texts without a key are linked like any others."""

from gridloom.llm import jaccard_join

WORDS = [f"w{i}" for i in range(400)]
NEAR = [" ".join(WORDS[:n] + [f"end{n}"]) for n in (400, 399, 398)]


def test_near_copies_without_keys_are_linked(make_docs):
    docs = make_docs([(None, NEAR[0]), (None, NEAR[1]), (None, NEAR[1]), (None, "quite another text of some other words"), (7, "one more that stands by itself")])
    out = jaccard_join.near_duplicates(docs, k=3, percent=90).collect()
    assert len(out) == 5 and len({r.mark for r in out if r.stays}) == 3
    assert len(jaccard_join.keep_one(docs, k=3, percent=90).collect()) == 3


def test_a_text_without_key_connects(make_docs):
    # The outer two share too little at this threshold; the middle one has no key.
    low, middle, high = (" ".join(WORDS[a : a + 300]) for a in (0, 12, 24))
    docs = make_docs([(1, low), (None, middle), (3, high)])
    out = jaccard_join.near_duplicates(docs, k=3, percent=90).collect()
    assert {r.component for r in out} == {1}
    apart = jaccard_join.near_duplicates(docs.where("doc_id IS NOT NULL"), k=3, percent=90).collect()
    assert {r.component for r in apart} == {1, 3}
