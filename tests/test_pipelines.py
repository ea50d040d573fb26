"""Golden results of the pipelines, in batch and as streams."""

from __future__ import annotations

import pytest
from conftest import rows

from pyspark.sql import functions as F

from tidemark.functions.timed import add_timestamp
from tidemark.plans.harass import harass_max
from tidemark.plans.pollution import pollution1, pollution2, pollution3, sensor_spans, sensor_window_mean, span_levels
from tidemark.plans.tips import hourly_max, max_hourly_tips, tips_per_hour_driver
from tidemark.sources.files import read_sensors
from tidemark.streaming.recorder import record_stream, replay

POLLUTION1 = [(4000, 1, "Alert"), (4000, 2, "Notice"), (5000, 1, "Warning"), (6000, 1, "Notice")]
SLIDING = [(4000, 1, "Alert"), (4000, 2, "Notice"), (5000, 1, "Alert"), (5000, 2, "Notice"), (6000, 1, "Alert"),
           (6000, 2, "Notice"), (7000, 1, "Warning"), (8000, 1, "Notice")]
POLLUTION2 = [(3000, "OK"), (4000, "OK"), (5000, "Notice"), (6000, "Alert"), (7000, "Warning"), (8000, "OK"), (9000, "OK")]
POLLUTION3 = [(3000, "OK", []), (4000, "OK", []), (5000, "Alert", [1, 2, 3]), (6000, "Warning", [1, 2, 3]),
              (7000, "Notice", [1, 3, 4]), (8000, "OK", []), (9000, "OK", [])]


def with_sensors(levels, *keys):
    """The rows of a window as one row with a list, to compare with what is known."""
    grouped = levels.groupBy(*keys, "ts", "w_end", "level")
    return grouped.agg(F.sort_array(F.collect_list("sensor_id")).alias("sensors"))


GOLDEN = [
    ("sensor1", pollution1, ("w_end", "sensor_id", "level"), POLLUTION1),
    ("sensor1", lambda df: pollution1(df, "3 seconds", "1 second"), ("w_end", "sensor_id", "level"), SLIDING),
    ("sensor2", pollution2, ("w_end", "level"), POLLUTION2),
]


@pytest.mark.parametrize("name,pipeline,columns,expected", GOLDEN)
def test_golden_batch(spark, sensor_files, name, pipeline, columns, expected):
    df = read_sensors(spark, sensor_files[name])
    assert rows(pipeline(df), *columns) == expected


@pytest.mark.parametrize("name,pipeline,columns,expected", GOLDEN)
def test_golden_stream(spark, sensor_files, name, pipeline, columns, expected):
    df = read_sensors(spark, sensor_files[name], streaming=True)
    assert rows(record_stream(df, pipeline, name), *columns) == expected


def test_golden_levels_with_sensors(spark, sensor_files):
    df = read_sensors(spark, sensor_files["sensor3"])
    assert rows(with_sensors(pollution3(df)), "w_end", "level", "sensors") == POLLUTION3
    spans = record_stream(read_sensors(spark, sensor_files["sensor3"], streaming=True), sensor_spans, "spans")
    assert rows(with_sensors(span_levels(spans)), "w_end", "level", "sensors") == POLLUTION3


def test_window_result_carries_its_last_millisecond(spark, sensor_files):
    df = pollution1(read_sensors(spark, sensor_files["sensor1"]))
    assert add_timestamp(df).where(F.col("tms") != F.col("w_end") - 1).count() == 0


def test_extra_keys_keep_cases_apart(spark, sensor_files):
    df = read_sensors(spark, sensor_files["sensor3"])
    both = df.withColumn("case_id", F.lit(1)).unionByName(df.withColumn("case_id", F.lit(2)))
    got = with_sensors(pollution3(both, keys=["case_id"]), "case_id")
    for case in (1, 2):
        assert rows(got.where(F.col("case_id") == case), "w_end", "level", "sensors") == POLLUTION3


def test_sensor_window_mean(spark, sensor_files):
    df = read_sensors(spark, sensor_files["sensor3"]).where("sensor_id = 1 AND timestamp < 4000")
    assert rows(sensor_window_mean(df), "w_end", "concentration", "last_tms") == [(3000, 425.0, 2400), (4000, 425.0, 3400)]


def test_window_ends_of_an_uneven_slide(spark, sensor_files):
    df = read_sensors(spark, sensor_files["sensor2"])
    levels = pollution2(df, "5 seconds", "2 seconds").collect()
    assert sorted(r["w_end"] for r in levels) == [3000, 5000, 7000, 9000, 11000]
    assert all(r["ts"].timestamp() * 1000 // 1 == r["w_end"] - 1 for r in levels)


def test_nan_mean_is_over_no_limit(spark):
    df = spark.createDataFrame([(100, s, float("nan")) for s in range(5)], "tms BIGINT, sensor_id INT, concentration DOUBLE")
    df = df.withColumn("ts", F.timestamp_millis("tms"))
    assert {r["level"] for r in pollution2(df).collect()} == {"OK"}
    assert {r["level"] for r in pollution1(df).collect()} == {"OK"}


def test_harass_max(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (10, 1, 9.0), (3_600_000, 1, 1.0), (5, 2, 6.0)], "tms BIGINT, zone_id INT, danger DOUBLE")
    df = df.withColumn("ts", F.timestamp_millis("tms"))
    assert rows(harass_max(df), "w_end", "zone_id", "level") == [
        (3_600_000, 1, "Extreme"), (3_600_000, 2, "Danger"), (7_200_000, 1, "Safe")]


def fares(spark, data):
    df = spark.createDataFrame(data, "tms BIGINT, driver_id BIGINT, tip DOUBLE")
    return df.withColumn("ts", F.timestamp_millis("tms"))


def test_tips_and_maximum(spark):
    df = fares(spark, [(0, 1, 5.0), (10, 1, 5.0), (20, 2, 9.0), (3_600_000, 2, 1.0)])
    assert rows(tips_per_hour_driver(df), "w_end", "driver_id", "tips") == [
        (3_600_000, 1, 10.0), (3_600_000, 2, 9.0), (7_200_000, 2, 1.0)]
    assert rows(hourly_max(df), "w_end", "driver_id", "tips") == [(3_600_000, 1, 10.0), (7_200_000, 2, 1.0)]


def test_equal_tips_give_one_row(spark):
    df = fares(spark, [(0, 7, 5.0), (1, 3, 5.0), (2, 9, 5.0)])
    assert rows(max_hourly_tips(tips_per_hour_driver(df)), "driver_id", "tips") == [(3, 5.0)]


def test_stream_in_several_batches_equals_batch(spark):
    """Files in time order, one per micro-batch."""
    df = fares(spark, [(i * 600_000, i % 3, float(i % 7)) for i in range(60)])
    stream = replay(df.coalesce(1).sortWithinPartitions("tms"), "ordered", files_per_trigger=1)
    got = record_stream(stream, hourly_max, "ordered")
    assert rows(got, "w_end", "driver_id", "tips") == rows(hourly_max(df), "w_end", "driver_id", "tips")
