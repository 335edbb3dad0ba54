"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes the documents that the one before it kept and returns those that it keeps, with the
columns of ``documents`` (the last one adds ``ids``).  Every stage handles null and empty texts, repeated
rows, null keys, clashing names of other columns and empty tables as its operator in gridloom/llm states:
the quality stage keeps or drops a row by its text alone; exact dedup keeps the row with the largest doc_id of equal
texts; near dedup (five words, similarity 0.8) keeps the row with the smallest doc_id of a component and
all rows without words; mixing takes rows zero to three times; the last stage encodes every row it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, jaccard_join, mixing, pieces, quality
from gridloom.session import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, accepts (score 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near-equal word shingles, the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, segmented with merge-dropout; copies that mixing made differ."""
    return pieces.encode(docs, copies=True)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_contents),
    ("mixing sources", mixed_sources),
    ("SentencePiece encoding", token_ids),
]

#: The classifier and the tokenizer have no SQL form; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stage(docs, "pipeline")
    return docs
