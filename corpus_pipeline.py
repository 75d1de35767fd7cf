"""Documents to packed training bins: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gustline.llm import chunk_dedup, decontaminate, language, ngram_join, packing
from gustline.session import delete_on_exit, ensure_checkpoint_dir, ship_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the rows that are not held out."""
    ship_package(spark)
    return language.recognised(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest doc_id."""
    ship_package(spark)
    return chunk_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links on five-word shingles (Jaccard 0.8 or more), that of the smallest doc_id."""
    ship_package(spark)
    return ngram_join.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins for the documents: one row per piece."""
    ship_package(spark)
    return packing.pack(packing.with_clusters(docs))


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The language model, the links and the bins are beyond SQL; tests/llm hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    Null and empty texts, ties and repeated rows are dealt with by each stage as its operator says; an empty table gives
    no rows, and columns of any name pass through all but the last stage.  The folders go when the application ends.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_on_exit(spark, root)
        docs = spark.read.parquet(path)
    return docs
