from __future__ import annotations

import random

import pytest
from conftest import rows

from pyspark.sql import functions as F

from oracle import TESTDATA
from suite import QUERIES
from tidemark.operators.atoms import foreach_element
from tidemark.operators.letters import letters, word_ends
from tidemark.operators.temporal import always, evaluate, now
from tidemark.operators.windows import Windows
from tidemark.session import scratch_path
from tidemark.streaming.monitor import complete_verdicts, monitor_always
from tidemark.streaming.recorder import _assert_flushed, record_stream, record_with_timestamps


def events(spark, seed=0, n=80):
    rng = random.Random(seed)
    data = sorted((rng.randint(0, 2999), rng.randint(0, 2), rng.randint(0, 9)) for _ in range(n))
    return data, spark.createDataFrame(data, "tms BIGINT, k INT, v INT").withColumn("ts", F.timestamp_millis("tms"))


def file_stream(spark, df, files):
    """A file stream of the table in time order, several files, one per micro-batch."""
    path = scratch_path(spark, "ordered")
    span = 3000 // files
    for i in range(files):
        part = df.where((F.col("tms") >= i * span) & (F.col("tms") < (i + 1) * span))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)


def test_flush_closes_all_windows(spark):
    _, df = events(spark)

    def counted(stream):
        window = F.window("ts", "100 milliseconds").alias("w")
        return stream.groupBy("k", window).count().select("k", F.unix_millis("w.end").alias("w_end"), "count")

    full = rows(counted(df))
    assert rows(record_stream(file_stream(spark, df, 5), counted, "flushed")) == full
    early = rows(record_stream(file_stream(spark, df, 5), counted, "unflushed", flush=False))
    assert set(early) < set(full)


def test_recorded_rows_carry_their_event_time(spark):
    _, df = events(spark)
    got = record_with_timestamps(file_stream(spark, df, 3).drop("tms"),
                                 lambda s: s, "recorded", flush=False)
    assert rows(got, "tms", "k", "v") == rows(df, "tms", "k", "v")


def by_window(stream, *more):
    window = F.window("ts", "100 milliseconds").alias("w")
    return stream.groupBy("k", window, *more).count().select("k", F.unix_millis("w.end").alias("w_end"), "count")


def test_a_filter_before_the_windows_does_not_lose_the_last_ones(spark):
    _, df = events(spark)
    for keep in (F.col("v") > 2, (F.col("k") == 1) & (F.col("v") < 9), F.col("v").isin(1, 2, 3)):
        got = record_stream(file_stream(spark, df, 5), lambda s, keep=keep: by_window(s.where(keep)), "filtered")
        assert rows(got) == rows(by_window(df.where(keep)))


def test_an_incomplete_flush_fails():
    class Query:
        def __init__(self, watermark, operators=({},)):
            self.lastProgress = {"stateOperators": list(operators), "eventTime": {"watermark": watermark}}

    with pytest.raises(RuntimeError, match="not flushed"):
        _assert_flushed(Query("2024-01-30T00:00:00.000Z"))
    _assert_flushed(Query("9000-01-01T00:00:00.000Z"))
    _assert_flushed(Query("2024-01-30T00:00:00.000Z", operators=()))  # nothing to flush


def test_a_table_of_many_files_is_a_stream_too(spark):
    root = scratch_path(spark, "folder-table")
    table = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet")
    table.repartition(5).write.parquet(f"{root}/events.parquet")
    for name in ("stream_pollution1", "record_roundtrip", "stream_hourly_max", "stream_monitor_always"):
        assert rows(QUERIES[name](spark, root)) == rows(QUERIES[name](spark, f"{TESTDATA}/sf0.001"))


def test_rows_before_the_start(spark):
    """A monitor takes strict windows only, and equals the batch verdicts on them."""
    _, df = events(spark, seed=4)
    early = Windows(100, start_ms=250, strict=True)

    def watched(stream):
        return monitor_always(stream, F.col("v") > 1, early, 3, ["k"])

    frames = record_stream(file_stream(spark, df, 5), watched, "early")
    word = letters(early, ["k"], rows=(df, [foreach_element("a", F.col("v") > 1)]))
    expected = rows(evaluate(word, always(now("a"), 3), ["k"]), "k", "idx", "value")
    assert rows(complete_verdicts(frames, word_ends(df, early, ["k"]), 3, True, ["k"]), "k", "idx", "value") == expected
    assert frames.where("idx < 0").count() == 0
    with pytest.raises(ValueError, match="strict"):
        monitor_always(df, F.col("v") > 1, Windows(100, start_ms=250), 3, ["k"])
