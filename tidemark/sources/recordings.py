"""Recorded streams: written once as parquet, read back as finite timed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def record_table(df: DataFrame, path: str) -> DataFrame:
    """Write a batch table and read it back (cuts lineage; the copy survives a lost executor)."""
    df.write.parquet(path)
    return read_recorded(df.sparkSession, path)


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """A recorded stream as a finite table."""
    return spark.read.parquet(path)
