"""A text corpus made ready for training: bad documents and near copies go, secrets are masked, sources are mixed, texts packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayprint.llm import best_fit, fair_mix, minhash_join, quality_cascade, secret_scan
from dayprint.llm.catalogue import vocabulary
from dayprint.llm.store import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_cascade.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the least doc_id stays."""
    return minhash_join.representatives(docs, threshold=0.8, width=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows."""
    return secret_scan.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order in which their sources take turns."""
    return fair_mix.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048."""
    return best_fit.pack(docs, vocabulary(), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality),
    ("n-gram join", near_duplicates),
    ("secret scans", secrets),
    ("mixture", mixture),
    ("packing", packing),
]
#: Token ids cannot be made in SQL; tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
