"""Sensor and taxi-fare text files, as batch tables or as file streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader
from pyspark.sql.streaming.readwriter import DataStreamReader

FARE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
FARE_FIELDS = ("ride_id", "taxi_id", "driver_id", "start_time", "payment_type", "tip", "tolls", "total_fare")


def _lines(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    reader: DataFrameReader | DataStreamReader = spark.readStream if streaming else spark.read
    return reader.text(path)


def _only(df: DataFrame, good: Column, what: str) -> DataFrame:
    """Fail the job with the offending line unless every line is good.

    It is a filter, so it stays whatever columns are read later, also when rows are only counted.
    """
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"bad {what}: "), F.col("value"))).cast("boolean")))


def read_sensors(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines ``timestamp,sensor_id,concentration``; further fields are ignored, a malformed line fails.

    Gives ``timestamp, sensor_id, concentration`` and the event time ``ts``.
    """
    part = F.split("value", ",", -1)
    typed = _lines(spark, path, streaming).select(
        "value",
        F.get(part, F.lit(0)).try_cast("bigint").alias("timestamp"),
        F.get(part, F.lit(1)).try_cast("int").alias("sensor_id"),
        F.get(part, F.lit(2)).try_cast("double").alias("concentration"),
    )
    good = F.col("timestamp").isNotNull() & F.col("sensor_id").isNotNull() & F.col("concentration").isNotNull()
    return _only(typed, good, "sensor in line").drop("value").withColumn("ts", F.timestamp_millis("timestamp"))


def _parse_fares(lines: DataFrame) -> DataFrame:
    # Trailing empty fields do not count as fields, so a line that ends in them is too short.
    part = F.split(F.regexp_replace("value", ",+$", ""), ",", -1)

    def field(i: int, type_: str) -> Column:
        return F.get(part, F.lit(i)).try_cast(type_)

    def amount(i: int) -> Column:
        text = F.get(part, F.lit(i))
        return F.when(text == "", F.lit(0.0).cast("float")).otherwise(text.try_cast("float"))

    parsed = lines.select(
        "value",
        F.size(part).alias("_n"),
        field(0, "bigint").alias("ride_id"),
        field(1, "bigint").alias("taxi_id"),
        field(2, "bigint").alias("driver_id"),
        F.try_to_timestamp(F.get(part, F.lit(3)), F.lit(FARE_TIME_FORMAT)).alias("start_time"),
        F.get(part, F.lit(4)).alias("payment_type"),
        amount(5).alias("tip"),
        amount(6).alias("tolls"),
        amount(7).alias("total_fare"),
    )
    complete = F.col("_n") == len(FARE_FIELDS)
    for name in FARE_FIELDS:
        complete = complete & F.col(name).isNotNull()
    return parsed.withColumn("_ok", complete).drop("_n")


def read_fares(spark: SparkSession, path: str, streaming: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Lines of eight comma-separated fare fields; empty amounts are 0.

    ``FAILFAST`` fails on a bad line, ``DROPMALFORMED`` leaves it out, ``PERMISSIVE`` keeps it in a
    ``_corrupt_record`` column (NULL on good lines).
    """
    parsed = _parse_fares(_lines(spark, path, streaming))
    if mode == "DROPMALFORMED":
        return parsed.where("_ok").select(*FARE_FIELDS)
    if mode == "PERMISSIVE":
        return parsed.select(*FARE_FIELDS, F.when(~F.col("_ok"), F.col("value")).alias("_corrupt_record"))
    if mode != "FAILFAST":
        raise ValueError(f"unknown mode {mode}")
    return _only(parsed, F.col("_ok"), "fare line").select(*FARE_FIELDS)


def event_time(df: DataFrame, column: str = "start_time", name: str = "tms") -> DataFrame:
    """Event time of a fare: its start in epoch milliseconds."""
    return df.withColumn(name, F.unix_millis(F.col(column)))


def fare_line(df: DataFrame) -> DataFrame:
    """Inverse of :func:`read_fares`: one text column ``value`` per fare."""
    texts = [
        F.date_format("start_time", FARE_TIME_FORMAT)
        if name == "start_time"
        else F.coalesce(F.col(name).cast("string"), F.lit(""))
        for name in FARE_FIELDS
    ]
    return df.select(F.concat_ws(",", *texts).alias("value"))


def write_fares(df: DataFrame, path: str) -> None:
    fare_line(df).write.mode("errorifexists").text(path)


def write_sensors(df: DataFrame, path: str) -> None:
    columns = [F.col(c).cast("string") for c in ("timestamp", "sensor_id", "concentration")]
    df.select(F.concat_ws(",", *columns).alias("value")).write.mode("errorifexists").text(path)
