"""One very long text beside short ones: the same features as a plain count, in bounded memory."""

import tracemalloc

import numpy as np
import pytest
from gridloom.llm import langid, quality, toxicity
from gridloom.llm.bytetext import Words
from gridloom.llm.features import NAMES, profile


@pytest.fixture(scope="module")
def long_text():
    words = ["".join(chr(97 + c) for c in row) for row in np.random.default_rng(5).integers(0, 26, (50_000, 5))]
    return " ".join(f"{w},{'YOU' if i % 9 else 'x1'}" for i, w in enumerate(words * 40))[:20_000_000]


def test_hashes_do_not_depend_on_the_blocks(long_text):
    data = np.frombuffer(long_text[:3_000_000].encode(), np.uint8)
    whole = Words(data, np.array([0, len(data)]))
    cut = Words(data[:1000], np.array([0, 1000]))
    assert (whole.hashes()[: len(cut.start) - 1] == cut.hashes()[:-1]).all()
    for i, j, found in whole.beginnings(range(3, 5)):
        assert (found[0] == whole.hashes()[i:j]).all()


def test_twenty_megabytes_in_bounded_memory(long_text):
    data = np.frombuffer(long_text.encode(), np.uint8)
    lexicon = toxicity.Lexicon(np.sort(np.random.default_rng(1).integers(1, 1 << 62, 100).astype(np.uint64)), np.ones(100))
    tracemalloc.start()
    row = toxicity.features(data, np.array([0, len(data)]), lexicon)
    assert tracemalloc.get_traced_memory()[1] < 45 * len(data)
    tracemalloc.stop()
    assert row.shape == (1, len(NAMES) + len(toxicity.EXTRA))
    found = dict(zip(NAMES, profile(data, np.array([0, len(data)]))[0], strict=True))
    assert found["log_words"] == np.log1p(len(long_text.split())) and found["log_bytes"] == np.log1p(len(long_text))


def test_all_classifiers_read_a_long_text(spark, make_docs, long_text):
    rows = [(i, f"you are number {i} in a line", ["en", "de"][i % 2]) for i in range(40)] + [(99, long_text, "en")]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for found in (quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels)), langid.predict(docs, langid.fit(docs))):
        assert found.count() == 41 and found.where("key = 99 AND score BETWEEN 0 AND 1").count() == 1
