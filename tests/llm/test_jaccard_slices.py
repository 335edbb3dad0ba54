"""Keys of the Jaccard join taken in slices, and what a staged table leaves on disk."""

from gridloom.llm import jaccard_join
from gridloom.session import stage
from pyspark.sql import functions as F


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counts = stage(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    assert not shuffle_files(spark) - before
    assert counts.count() == 1000


def test_slices_find_the_same_blocks(spark, monkeypatch):
    keys = stage(spark.sql("SELECT xxhash64(id % 700) AS block, xxhash64(id) AS node, cast(id % 4 AS int) AS spare FROM range(1000)"), "keys")
    whole = {tuple(r) for r in jaccard_join._shared_blocks(keys).collect()}
    asked = []
    monkeypatch.setattr(jaccard_join, "SLICE_ROWS", 300)
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: asked.append(name) or stage(df, name))
    rows = jaccard_join._shared_blocks(keys).collect()
    assert asked == ["blocks"] * 4
    assert len(rows) == len(whole) == 600 and {tuple(r) for r in rows} == whole


def test_slices_do_not_change_the_result(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*words[:i], f"x{n}", *words[i:]]) for n, i in enumerate(range(0, 120, 12))] + ["a b c", None, " ".join(words[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    result = lambda: {tuple(r) for r in jaccard_join.near_duplicates(docs, k=3, percent=80).select("key", "n_shingles", "component", "stays").collect()}
    whole = result()
    assert len({r[2] for r in whole}) == 4
    monkeypatch.setattr(jaccard_join, "SLICE_ROWS", 200)
    assert result() == whole
