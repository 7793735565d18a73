"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet into the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from posegrid.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from posegrid.llm._common import Scratch, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_first(docs, Scratch(spark, "exact"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8 or more) the smallest id stays."""
    return near_dedup.keep_one(docs, Scratch(spark, "near"), size=5, threshold=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "benchmark"))


def length_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place."""
    return packing.pack(docs, Scratch(spark, "packing"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("minhash near-dedup", near_duplicate_groups),
    ("benchmark decontamination", benchmark_passages),
    ("packing", length_batches),
]

#: Stages 1, 3 and 5 (a fitted model, MinHash, a dynamic programme) are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
    return docs
