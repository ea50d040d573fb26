"""Fare pipelines: input ``ts, driver_id, tip`` plus ``keys``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.event_windows import window_aggregate


def tips_per_hour_driver(df: DataFrame, size: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Sum of tips per driver and window."""
    return window_aggregate(df, {"tips": F.sum("tip")}, size, by=[*keys, "driver_id"])


def max_hourly_tips(tips: DataFrame, size: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """The driver with the largest sum in each window, one row per window; on a tie the smallest
    driver id, so that the result does not depend on row order."""
    best = F.max(F.struct("tips", (-F.col("driver_id")).alias("minus_id")))
    top = window_aggregate(tips, {"best": best}, size, by=keys)
    return top.select(
        *keys, "ts", "w_end", (-F.col("best.minus_id")).alias("driver_id"), F.col("best.tips").alias("tips")
    )


def hourly_max(df: DataFrame, size: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Tips per driver and window, then the best driver of each window."""
    return max_hourly_tips(tips_per_hour_driver(df, size, keys), size, keys)
