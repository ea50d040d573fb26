"""From raw documents to token records: five stages, each over all that the one before it kept.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``docs``.
``run`` writes each stage's result as Parquet in the shared folder and reads it again as the next one's
input, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, mixing, quality, records, simhash
from tidemark.llm.common import materialised

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality.judged(docs.select(F.struct("*").alias("row"), "doc_id", "text"), labels).where("quality.kept")
    return kept.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word Jaccard similarities of 0.8 or more link."""
    return simhash.representatives(docs, jaccard.classes)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture uses them: rows of several uses are repeated."""
    return mixing.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return records.token_records(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("target_mixing", target_mixing),
    ("token_records", token_records),
]

# Hash-based models, tokens and trained classifiers are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
