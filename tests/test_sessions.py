"""Windows after gaps, and binding by comparison, against plain Python."""

from __future__ import annotations

import math
import random
import re

import pytest
from conftest import rows
from oracle import TESTDATA, connect

from suite import ORACLES
from tidemark.operators.atoms import aggregate
from tidemark.operators.binding import bind_reaches
from tidemark.operators.letters import letters
from tidemark.operators.sessions import GapWindows, gap_numbers
from tidemark.operators.windows import Windows

from pyspark.sql import functions as F


def numbered(times, gap):
    out, number = {}, 0
    ordered = sorted(set(times))
    for i, t in enumerate(ordered):
        number += i > 0 and t - ordered[i - 1] > gap
        out[t] = number
    return out


@pytest.mark.parametrize("block", [1, 7, 50, 100_000])
def test_gap_numbers(spark, block):
    """Any block length gives the same numbers; a gap as long as allowed does not cut; times may be negative."""
    rng = random.Random(block)
    data = [(rng.choice(["a", "a", "b", None]), rng.randint(-300, 300)) for _ in range(120)]
    data += [("c", 0), ("c", 10), ("c", 21), ("a", None), ("a", 5), ("a", 5)]
    df = spark.createDataFrame(data, "k STRING, tms BIGINT")
    expected = [
        (k, t, n) for k in ("a", "b", "c", None)
        for t, n in numbered([t for key, t in data if key == k and t is not None], 10).items()
    ]
    got = [tuple(r) for r in gap_numbers(df, 10, ["k"], block_ms=block).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_letters_of_gap_windows(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 1, 2]), rng.randint(0, 400)) for _ in range(90)]
    df = spark.createDataFrame(data, "k INT, tms BIGINT")
    atoms = [aggregate("first", F.col("tms"), F.min), aggregate("last", F.col("tms"), F.max)]
    word = letters(GapWindows(9, ("k",), block_ms=40), ["k"], rows=(df, atoms))
    expected = []
    for k in (1, 2):
        mine = [t for key, t in data if key == k]
        number = numbered(mine, 9)
        for i in range(max(number.values()) + 1):
            inside = [t for t in mine if number[t] == i]
            expected.append((k, i, len(inside), min(inside), max(inside)))
    assert rows(word, "k", "idx", "n_rows", "first", "last") == sorted(expected)
    assert letters(GapWindows(9, ("k",)), ["k"], rows=(df.where("k > 5"), atoms)).count() == 0


def test_a_hot_case_is_many_tasks(spark):
    """Times of a case are ordered per block; only summaries of blocks are ordered per case."""
    df = spark.range(50_000).select((F.col("id") * 0).alias("k"), (F.col("id") * 1000).alias("tms"))
    plan = gap_numbers(df, 10, ["k"], block_ms=500_000)._jdf.queryExecution().analyzed().toString()
    specs = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    by_time = [spec for spec in specs if "tms#" in spec]
    assert by_time and all("_block#" in spec.split("tms#")[0] for spec in by_time)
    assert len(specs) > len(by_time)
    got = gap_numbers(df, 999, ["k"], block_ms=500_000)
    assert got.agg(F.max("number")).first()[0] == 49_999 and got.count() == 50_000


def test_bind_reaches(spark):
    rng = random.Random(5)
    values = [1.0, 2.0, 3.0, 4.0, None, math.nan]
    make = lambda n: [(rng.choice("xyz"), rng.randint(0, 99), rng.choice(values)) for _ in range(n)]
    early, late = make(40), make(80) + [("x", 99, 1.0)]
    windows, offsets = Windows(10), (0, 1, 3)
    schema = "kind STRING, tms BIGINT, v DOUBLE"
    e, l = spark.createDataFrame(early, schema), spark.createDataFrame(late, schema)
    word = letters(windows, rows=(l, []))
    got = rows(bind_reaches(word, e, l, windows, ["kind"], "v", offsets), "idx", *[f"bound_{o}" for o in offsets])

    def best(data, idx, kind):
        good = [v for k, t, v in data if k == kind and t // 10 == idx and v is not None and not math.isnan(v)]
        return max(good) if good else None

    def value(idx, o):
        if idx + o > 9:
            return 0
        for kind in "xyz":
            need, have = best(early, idx, kind), best(late, idx + o, kind)
            if need is not None and (have is None or have < need):
                return -1
        return 1

    assert got == [(i, *[value(i, o) for o in offsets]) for i in range(10)]
    assert {x for r in got for x in r[1:]} == {-1, 0, 1}


def test_bind_reaches_joins_no_rows(spark):
    df = spark.createDataFrame([("x", 0, 1.0)], "kind STRING, tms BIGINT, v DOUBLE")
    word = spark.createDataFrame([(0, 0)], "idx BIGINT, last_idx BIGINT")
    bound = bind_reaches(word, df, df, Windows(10), ["kind"], "v", [1, 2])
    assert bound._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the letters


@pytest.mark.parametrize("name", ["bound_reaches_level", "discretize_by_gap", "stream_monitor_until", "stream_monitor_nested"])
def test_verdicts_vary(name):
    assert connect(f"{TESTDATA}/sf0.01").execute(ORACLES[name]).df()["verdict"].nunique() == 3
