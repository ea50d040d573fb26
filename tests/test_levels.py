from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.levels import EMERGENCY_ORDER, danger_level, emergency_level, exceeds, level_rank

NAN = float("nan")


def test_emergency_levels(spark):
    values = [180.0, 180.1, 200.0, 200.1, 400.0, 400.1, NAN, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, c DOUBLE")
    got = [r[0] for r in df.orderBy("i").select(emergency_level(F.col("c"))).collect()]
    assert got == ["OK", "Notice", "Notice", "Warning", "Warning", "Alert", "OK", "OK"]


def test_danger_levels(spark):
    values = [1.0, 1.1, 5.0, 5.1, 8.0, 8.1, NAN]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, d DOUBLE")
    got = [r[0] for r in df.orderBy("i").select(danger_level(F.col("d"))).collect()]
    assert got == ["Safe", "Warning", "Warning", "Danger", "Danger", "Extreme", "Extreme"]


@pytest.mark.parametrize("level,rank", [("Alert", 0), ("OK", 3)])
def test_rank(spark, level, rank):
    assert spark.range(1).select(level_rank(F.lit(level), EMERGENCY_ORDER)).first()[0] == rank


def test_exceeds_is_false_for_nan_and_null(spark):
    df = spark.createDataFrame([(NAN,), (None,), (401.0,)], "c DOUBLE")
    assert [r[0] for r in df.select(exceeds(F.col("c"), 400.0)).collect()] == [False, False, True]
