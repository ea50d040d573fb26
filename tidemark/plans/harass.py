"""Incident pipeline: input ``ts, zone_id, danger`` plus ``keys``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.levels import danger_level
from tidemark.operators.event_windows import window_aggregate


def harass_max(df: DataFrame, size: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Danger level of every zone by its maximum in the window."""
    top = window_aggregate(df, {"top": F.max("danger")}, size, by=[*keys, "zone_id"])
    return top.select(*keys, "ts", "w_end", "zone_id", danger_level(F.col("top")).alias("level"))
