"""Functions with state and timers: the same in one micro-batch and in many."""

from __future__ import annotations

import pytest
from conftest import rows
from test_streaming import events, file_stream

from pyspark.sql import functions as F

from tidemark.streaming.keyed import KeyedFunction, process_keyed
from tidemark.streaming.levels import level_changes
from tidemark.streaming.recorder import record_stream

SILENCE = 150


def changes(data):
    """``k, at, before, level`` by walking over each key's highest value per 10 ms, stamped at its end."""
    out = []
    for k in {k for _, k, _ in data}:
        tops = {}
        for t, key, v in data:
            if key == k:
                tops[t // 10] = max(v, tops.get(t // 10, -1))
        before, last = None, None
        for w in sorted(tops):
            at, level = w * 10 + 9, "high" if tops[w] > 5 else "low"
            if last is not None and at - last > SILENCE:
                out.append((k, last + SILENCE, before, None))
                before = None
            if level != before:
                out.append((k, at, before, level))
            before, last = level, at
        out.append((k, last + SILENCE, before, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("files", [1, 6])
def test_level_changes(spark, files):
    data, df = events(spark, seed=9, n=120)

    def subject(stream):
        tops = stream.groupBy("k", F.window("ts", "10 milliseconds").alias("w")).agg(F.max("v").alias("top"))
        level = F.when(F.col("top") > 5, "high").otherwise("low").alias("level")
        return level_changes(tops.select("k", (F.unix_millis("w.end") - 1).alias("tms"), level), SILENCE, ["k"])

    out = record_stream(file_stream(spark, df, files), subject, "changes")
    got = sorted((tuple(r) for r in out.select("k", "at", "before", "level").collect()), key=str)
    assert got == changes(data) and any(r[3] is None for r in got)


class Sums(KeyedFunction):
    """A function defined outside the library: running sums, without timers; NULL where a sum is odd."""

    output = "k INT, tms BIGINT, total BIGINT"
    state = "total BIGINT"

    def row(self, key, row, state):
        total = (state[0] if state else 0) + row.v
        return [(key[0], row.tms, None if total % 2 else total)], (total,), None


def test_a_function_of_ones_own(spark):
    """Rows of one micro-batch may come in any order; rows without a key are dropped."""
    data = sorted({(t, k): (t, k, v) for t, k, v in events(spark, seed=2, n=50)[0]}.values())
    df = spark.createDataFrame([*reversed(data), (5, None, 1)], "tms BIGINT, k INT, v INT")
    df = df.withColumn("ts", F.timestamp_millis("tms"))
    out = record_stream(
        file_stream(spark, df, 1), lambda s: process_keyed(s.select("k", "tms", "v", "ts"), Sums(), ["k"]), "sums"
    )
    expected, totals = [], {}
    for t, k, v in data:
        totals[k] = totals.get(k, 0) + v
        expected.append((k, t, None if totals[k] % 2 else totals[k]))
    assert rows(out, "k", "tms", "total") == rows(spark.createDataFrame(expected, "k INT, tms BIGINT, total BIGINT"))
