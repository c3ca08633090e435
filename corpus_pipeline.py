"""The corpus pipeline: documents of quality, each text once, mixed to weights and packed.

Every stage takes what its predecessor kept and hands on rows with the columns of ``documents``; the
last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddslake.llm import exact_dedup, mixing, ngram_join, quality_rules, vector_packing
from oddslake.llm.common import with_package
from oddslake.session import prepare, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no robust outliers of their language and source."""
    with_package(prepare(spark))
    return quality_rules.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    with_package(prepare(spark))
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the row with the smallest id."""
    with_package(prepare(spark))
    return ngram_join.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    with_package(prepare(spark))
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the sequences."""
    with_package(prepare(spark))
    return vector_packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram join", near), ("mixing", mixture), ("packing", packed)]

#: Tokens, set joins and packing have no SQL form; the tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stored(docs)
    return docs
