from __future__ import annotations

from conftest import rows

from pyspark.sql import functions as F

from tidemark.functions.mixing import MODULUS, mix, pick_int, pick_tenths
from tidemark.operators import generators as g
from tidemark.operators.windows import Windows


def cases(spark, n=40):
    return g.cases_from(spark.range(n).union(spark.range(n)), "id")


def test_one_case_per_key(spark):
    assert cases(spark, 5).count() == 5


def test_same_rows_whatever_the_partitioning(spark):
    one = g.rows_n_to_m(g.always_windows(cases(spark).repartition(1), 3), 1, 5)
    many = g.rows_n_to_m(g.always_windows(cases(spark).repartition(7), 3), 1, 5)
    assert rows(one) == rows(many)


def test_n_to_m_rows_per_window(spark):
    per_window = g.rows_n_to_m(g.always_windows(cases(spark), 10), 3, 9).groupBy("case_id", "idx").count()
    assert per_window.count() == 400
    assert {r[0] for r in per_window.select("count").distinct().collect()} == set(range(3, 10))


def test_exactly_n_rows(spark):
    per_window = g.rows_n(g.always_windows(cases(spark), 2), 4).groupBy("case_id", "idx").count()
    assert rows(per_window.select("count").distinct()) == [(4,)]


def test_eventually_uses_one_window_per_case(spark):
    placed = g.eventually_window(cases(spark), 6)
    assert placed.count() == 40
    assert {r["idx"] for r in placed.collect()} == set(range(6))


def test_until_ends_with_one_released_window(spark):
    windows = g.until_windows(cases(spark), 5)
    per_case = windows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"), F.count_if("released").alias("released"),
        F.max(F.when(F.col("released"), F.col("idx"))).alias("at"),
    )
    assert per_case.where("n <> last + 1 OR released <> 1 OR at <> last OR last > 4").count() == 0


def test_later_concat_and_merge(spark):
    one = g.rows_n(g.always_windows(cases(spark, 1), 2), 1).select("case_id", "idx", "row", "h")
    assert rows(g.later(one, 3), "idx") == [(3,), (4,)]
    assert rows(g.concat(one, one, 2), "idx") == [(0,), (1,), (2,), (3,)]
    assert rows(g.merge(one, one, 1), "idx", "row") == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_times_are_inside_their_windows(spark):
    w = Windows(50, start_ms=1000)
    placed = g.place_tumbling(g.rows_n_to_m(g.always_windows(cases(spark), 10), 10, 50), w)
    assert placed.where(F.floor((F.col("tms") - 1000) / 50) != F.col("idx")).count() == 0
    assert placed.select(((F.col("tms") - 1000) % 50).alias("o")).distinct().count() == 50


def test_values_cover_their_range(spark):
    h = spark.range(5000).select(mix(F.col("id")).alias("h"))
    assert h.where((F.col("h") < 0) | (F.col("h") >= MODULUS)).count() == 0
    ints = h.select(pick_int(F.col("h"), 3, 7).alias("v")).groupBy("v").count()
    assert rows(ints, "v") == [(v,) for v in range(3, 8)]
    assert ints.agg(F.max("count") / F.min("count")).first()[0] < 1.3
    low, high = h.select(pick_tenths(F.col("h"), 0.5, 10.0).alias("v")).agg(F.min("v"), F.max("v")).first()
    assert (low, high) == (0.5, 10.0)
