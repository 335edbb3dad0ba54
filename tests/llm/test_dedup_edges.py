"""A text that occurs once and clashes with a copied text's digest."""

from pyspark.sql import functions as F

from gridloom.llm import exact_dedup


def test_single_text_with_the_digest_of_copies_is_kept(make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.lit("same"))
    out = exact_dedup.decisions(make_docs([(1, "a"), (2, "a"), (3, "once")])).collect()
    assert {(r.key, r.keep_key, r.group_size, r.kept) for r in out} == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)}
