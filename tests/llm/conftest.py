import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, digest string, score double, node long, `size` long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]); other columns have names that operators use too."""

    def build(rows):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"][len(r) - 2 :]), 7, "k", 1, "d", 0.5, 3, 9) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture(scope="session")
def messy(make_docs):
    long = " ".join(f"w{i % 977}x{i % 331}" for i in range(30_000))
    return make_docs([
        (1, "a b c d e f g h", "en", "s"), (5, "a b c d e f g h", None, "t"), (5, "a b c d e f g h", None, "t"), (2, None, "de", None),
        (3, "", "de", "s"), (None, "a b c d e f g h", "en", "s"), (4, long, "fr", "t"), (6, "x", "en", None), (7, "Ünder ▁ the\tsea \n 12", "en", "u"),
        (8, "  \n ", "en", "u"), (None, None, None, None), (9, "A B C D E F G H", "en", "u"), (10, "!!! ??? 123", "en", "u"),
    ])
