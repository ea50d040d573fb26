"""The ``events`` table read as sensor readings, incidents or fares, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """``events`` with an instant for event time (a watermark needs TIMESTAMP)."""
    if streaming:
        # A pattern that matches the table only, be it one file or a folder of part files.
        raw = spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parque[t]")
    else:
        raw = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("tms", F.unix_millis("ts"))


def sensors(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """``event_id, ts, tms, sensor_id, concentration``: every threshold level occurs."""
    return _timed(events(spark, sf_dir, streaming)).select(
        "event_id", "ts", "tms", F.col("user_id").alias("sensor_id"), (F.col("value") * 4).alias("concentration")
    )


def incidents(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """``event_id, ts, tms, zone_id, danger`` with danger in 0..10."""
    return _timed(events(spark, sf_dir, streaming)).select(
        "event_id",
        "ts",
        "tms",
        F.col("user_id").alias("zone_id"),
        F.least(F.col("value") / 10, F.lit(10.0)).alias("danger"),
    )


def fares(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Purchases as fares: ``event_id, ts, tms, driver_id, tip``."""
    purchases = _timed(events(spark, sf_dir, streaming)).where(F.col("event_type") == "purchase")
    return purchases.select("event_id", "ts", "tms", F.col("user_id").alias("driver_id"), F.col("value").alias("tip"))
