from __future__ import annotations

import pytest
from conftest import rows

from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources.files import event_time, fare_line, read_fares, read_sensors, write_fares, write_sensors
from tidemark.sources.recordings import record_table

GOOD = "1,2,3,2013-01-01 00:00:00,CSH,1.5,0,10"
EMPTY_AMOUNTS = "1,2,3,2013-01-01 00:00:00,CSH,,,10"
BAD = ["1,2,3,2013-01-01 00:00:00,CSH,1.5,0,", "x,2,3,2013-01-01 00:00:00,CSH,1,1,1",
       "1,2,3,2013-01-01,CSH,1,1,1", "1,2,3,2013-01-01 00:00:00,CSH,1,1,1,1", ""]


def text(spark, lines):
    path = scratch_path(spark, "text")
    spark.createDataFrame([(line,) for line in lines], "value STRING").write.text(path)
    return path


def test_sensor_file(spark, sensor_files):
    df = read_sensors(spark, sensor_files["sensor1"])
    assert rows(df, "timestamp", "sensor_id", "concentration") == [
        (3100, 1, 405.0), (3200, 2, 185.0), (4100, 1, 210.0), (5100, 1, 185.0)]
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "int", "double", "timestamp"]
    assert df.select(F.unix_millis(F.min("ts"))).first()[0] == 3100


def test_sensor_extra_fields_are_ignored(spark):
    assert rows(read_sensors(spark, text(spark, ["1,2,3.5,extra,more"])), "timestamp", "concentration") == [(1, 3.5)]


@pytest.mark.parametrize("line", ["a,1,2", "1,b,2", "1,2,c", "1,2"])
def test_malformed_sensor_line_fails(spark, line):
    with pytest.raises(Exception, match="in line"):
        read_sensors(spark, text(spark, [line])).collect()


def test_sensor_round_trip(spark):
    path = scratch_path(spark, "sensors")
    write_sensors(spark.createDataFrame([(5, 1, 0.1)], "timestamp BIGINT, sensor_id INT, concentration DOUBLE"), path)
    assert rows(read_sensors(spark, path).drop("ts")) == [(5, 1, 0.1)]


def test_fares(spark):
    df = event_time(read_fares(spark, text(spark, [GOOD, EMPTY_AMOUNTS])))
    assert rows(df, "ride_id", "tms", "payment_type", "tip", "tolls", "total_fare") == [
        (1, 1356998400000, "CSH", 0.0, 0.0, 10.0), (1, 1356998400000, "CSH", 1.5, 0.0, 10.0)]


@pytest.mark.parametrize("line", BAD)
def test_bad_fare_line_fails(spark, line):
    with pytest.raises(Exception, match="bad fare line"):
        read_fares(spark, text(spark, [GOOD, line])).collect()


def test_bad_fare_lines_can_be_kept_apart(spark):
    path = text(spark, [GOOD, *BAD])
    assert read_fares(spark, path, mode="DROPMALFORMED").count() == 1
    kept = read_fares(spark, path, mode="PERMISSIVE")
    assert rows(kept.where(F.col("_corrupt_record").isNotNull()), "_corrupt_record") == sorted((b,) for b in BAD)
    with pytest.raises(ValueError):
        read_fares(spark, path, mode="other")


def test_fare_line_is_the_inverse_of_reading(spark):
    df = read_fares(spark, text(spark, [GOOD, EMPTY_AMOUNTS]))
    path = scratch_path(spark, "fares")
    write_fares(df, path)
    assert rows(read_fares(spark, path)) == rows(df)
    assert rows(fare_line(df))[0] == ("1,2,3,2013-01-01 00:00:00,CSH,0.0,0.0,10.0",)


def test_fares_are_one_row_per_ride_id(spark):
    df = read_fares(spark, text(spark, [GOOD, EMPTY_AMOUNTS]))
    assert df.dropDuplicates(["ride_id"]).count() == 1


def test_record_table(spark):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    assert rows(record_table(df, scratch_path(spark, "t"))) == rows(df)


@pytest.mark.parametrize("bad", ["x,7,2.5", "5,y,2.5", "5,7,", "5,7"])
def test_a_bad_sensor_line_fails_whatever_is_read(spark, bad):
    path = scratch_path(spark, "bad-sensor")
    spark.createDataFrame([("1,2,3.5",), (bad,)], "value STRING").write.text(path)
    df = read_sensors(spark, path)
    for use in (df.count, *(df.select(c).collect for c in df.columns)):
        with pytest.raises(Exception, match="bad sensor in line"):
            use()


@pytest.mark.parametrize("bad", ["x,2,3,2013-01-01 00:00:00,CSH,1,1,1", "1,2,3,nope,CSH,1,1,1", "1,2,3,2013-01-01 00:00:00,CSH,z,1,1", "1,2"])
def test_a_bad_fare_line_fails_whatever_is_read(spark, bad):
    path = scratch_path(spark, "bad-fare")
    spark.createDataFrame([("1,2,3,2013-01-01 00:00:00,CSH,1.5,0,10",), (bad,)], "value STRING").write.text(path)
    df = read_fares(spark, path)
    for use in (df.count, *(df.select(c).collect for c in df.columns)):
        with pytest.raises(Exception, match="bad fare line"):
            use()
