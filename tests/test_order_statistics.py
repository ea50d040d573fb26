"""Exact order statistics against plain Python, with and without rounds of bins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.order_statistics import values_at_ranks, window_median

INF = math.inf


def ranks():
    return {"first": F.lit(1), "second": F.lit(2), "middle": F.floor((F.col("n_rows") + 1) / 2), "last": F.col("n_rows")}


def expected(rows):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    out = []
    for g, vs in groups.items():
        vs.sort()
        out.append((g, len(vs), vs[0], vs[1] if len(vs) > 1 else None, vs[(len(vs) - 1) // 2], vs[-1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_ranks(spark, few):
    rng = random.Random(few)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.uniform(0, 1e9), 5.0])) for _ in range(1500)]
    rows += [("ends", v) for v in (-INF, INF, INF, 1e308, -1e308, 0.0, 1e-308, 3.0, 4.0)]
    rows += [("one", 2.0), ("ties", 1.0), ("ties", 1.0), ("ties", 1.0), ("none", None), ("none", math.nan)]
    rows += [(None, 1.0), (None, None), (None, 9.0), ("near", 1.0), ("near", math.nextafter(1.0, 2)), ("near", math.nextafter(1.0, 0))]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(4)
    got = sorted(map(tuple, values_at_ranks(df, "v", ranks(), ["g"], few).collect()), key=str)
    assert got == expected(rows)


def test_without_rows_or_keys(spark):
    df = spark.createDataFrame([], "v DOUBLE")
    assert values_at_ranks(df, "v", ranks(), []).where("n_rows > 0").count() == 0
    df = spark.createDataFrame([(3,), (1,), (2,)], "v INT")
    assert [tuple(r) for r in values_at_ranks(df, "v", {"x": F.lit(2)}, []).collect()] == [(3, 2.0)]


def test_median_of_sliding_windows(spark):
    rows = [(t, float(v)) for t, v in zip([0, 10, 20, 30], [4, 1, 3, 100])]
    df = spark.createDataFrame(rows, "s BIGINT, v DOUBLE").select(F.timestamp_seconds("s").alias("ts"), "v")
    got = window_median(df, "v", "20 seconds", "10 seconds").orderBy("w_end").drop("ts").collect()
    assert [tuple(r) for r in got] == [(10_000, 1, 4.0), (20_000, 2, 2.5), (30_000, 2, 2.0), (40_000, 2, 51.5), (50_000, 1, 100.0)]


def test_one_group_with_most_rows_is_split(spark):
    """Rounds leave no more than ``few`` values of a group to one task, and no plan has all rows of a group."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    result = values_at_ranks(df, "v", {"middle": F.floor((F.col("n_rows") + 1) / 2)}, ["g"], few=50)
    want = sorted(r.v for r in df.where("g = 0").collect())[4999]
    assert result.where("g = 0").first().middle == want
