"""Sensor pipelines.

Input: ``ts TIMESTAMP, sensor_id, concentration`` plus the columns named in ``keys`` (for
example a test case id), in batch or as a stream with a watermark on ``ts``. Output rows carry
``ts`` (the last instant of their window) and ``w_end`` (epoch milliseconds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.levels import EMERGENCY_LIMITS, emergency_level, exceeds, level_by_counts
from tidemark.operators.aggregates import counted, maximum, mean, minimum
from tidemark.operators.event_windows import sliding_aggregate, window_aggregate


def pollution1(
    df: DataFrame, size: str = "1 second", slide: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Level of every sensor by its maximum in the window."""
    by = [*keys, "sensor_id"]
    if slide is None:
        top = window_aggregate(df, {"top": F.max("concentration")}, size, by=by)
    else:
        top = sliding_aggregate(df, {"top": maximum(F.col("concentration"))}, size, slide, by)
    return top.select(*keys, "ts", "w_end", "sensor_id", emergency_level(F.col("top")).alias("level"))


def pollution2(
    df: DataFrame, size: str = "3 seconds", slide: str = "1 second", keys: Sequence[str] = ()
) -> DataFrame:
    """Global level by the number of sensors whose mean in the sliding window is over a limit."""
    means = sliding_aggregate(df, {"mean": mean(F.col("concentration"))}, size, slide, [*keys, "sensor_id"])
    counts = {name: F.count_if(exceeds(F.col("mean"), limit)) for name, limit in EMERGENCY_LIMITS}
    level = level_by_counts({name: F.col(name) for name in counts})
    # Times are in milliseconds, so the last one of a window's result holds nothing but that window, whatever size and slide are.
    return window_aggregate(means, counts, "1 millisecond", by=keys).select(*keys, "ts", "w_end", level.alias("level"))


def sensor_window_mean(df: DataFrame, slot: str = "1 second", keys: Sequence[str] = ()) -> DataFrame:
    """Mean per sensor and slot, with the last event time it covers."""
    values = {"concentration": F.avg("concentration"), "last_tms": F.unix_millis(F.max("ts"))}
    return window_aggregate(df, values, slot, by=[*keys, "sensor_id"])


def sensor_spans(
    df: DataFrame,
    slot: str = "1 second",
    size: str = "3 seconds",
    slide: str = "1 second",
    min_slots: int = 3,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``ts, w_end, keys..., sensor_id, low``: the lowest slot mean of every sensor in every sliding
    window; NULL with fewer than ``min_slots`` slots. One row per window and sensor, also as a stream."""
    by = [*keys, "sensor_id"]
    slots = window_aggregate(df, {"mean": F.avg("concentration")}, slot, by=by)
    spans = sliding_aggregate(slots, {"low": minimum(F.col("mean")), "n": counted()}, size, slide, by)
    return spans.withColumn("low", F.when(F.col("n") >= min_slots, F.col("low"))).drop("n")


def span_levels(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., ts, w_end, level, sensor_id``: the level of every window with each sensor that is over its
    limit, one row per sensor; a window without a level (OK) has one row without a sensor."""
    window = [*keys, "ts", "w_end"]
    counts = {name: F.count_if(exceeds(F.col("low"), limit)) for name, limit in EMERGENCY_LIMITS}
    per_window = spans.groupBy(*window).agg(*[c.alias(name) for name, c in counts.items()])
    levels = per_window.select(*window, level_by_counts({name: F.col(name) for name in counts}).alias("level"))
    levels = levels.withColumn("limit", F.coalesce(*[F.when(F.col("level") == name, F.lit(float(x))) for name, x in EMERGENCY_LIMITS]))
    over = spans.where(exceeds(F.col("low"), min(x for _, x in EMERGENCY_LIMITS))).select(*window, "sensor_id", "low")
    joined = levels.join(over, window, "left")
    # Sensors over the lowest limit but not over the level's: their window keeps one row in any case.
    chosen = joined.where(exceeds(F.col("low"), F.col("limit"))).select(*window, "level", "sensor_id")
    none = levels.where(F.col("limit").isNull()).select(*window, "level", F.lit(None).cast(spans.schema["sensor_id"].dataType).alias("sensor_id"))
    return chosen.unionByName(none)


def pollution3(
    df: DataFrame,
    slot: str = "1 second",
    size: str = "3 seconds",
    slide: str = "1 second",
    min_slots: int = 3,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Global level and its sensors, one row per window and sensor: a sensor counts when all its slot means
    in the window are over the limit and there are at least ``min_slots`` of them. A stream records
    ``sensor_spans`` and takes the levels of what was recorded."""
    return span_levels(sensor_spans(df, slot, size, slide, min_slots, keys), keys)
