from __future__ import annotations

import random

import pytest

from tidemark.operators.binding import bind_subset
from tidemark.operators.letters import letters
from tidemark.operators.windows import Windows

W = Windows(10)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    early = {(rng.randint(0, 2), rng.randint(0, 79), rng.randint(0, 3)) for _ in range(40)}
    late = {(rng.randint(0, 2), rng.randint(0, 79), rng.randint(0, 3)) for _ in range(90)}
    schema = "case_id INT, tms BIGINT, k INT"
    e, l = spark.createDataFrame(sorted(early), schema), spark.createDataFrame(sorted(late), schema)
    word = letters(W, ["case_id"], e=(e, []), l=(l, []))
    offsets = range(4)
    got = {(r["case_id"], r["idx"]): tuple(r[f"bound_{o}"] for o in offsets)
           for r in bind_subset(word, e, l, W, ["k"], offsets, ["case_id"]).collect()}

    def keys(rows, case, i):
        return {k for c, t, k in rows if c == case and t // 10 == i}

    expected = {}
    for case in range(3):
        ends = [max((t // 10 for c, t, _ in side if c == case), default=-1) for side in (early, late)]
        for i in range(min(ends) + 1):
            expected[case, i] = tuple(
                0 if i + o > min(ends) else (1 if keys(early, case, i) <= keys(late, case, i + o) else -1)
                for o in offsets
            )
    assert got == expected


def test_letter_without_keys_holds(spark):
    schema = "tms BIGINT, k INT"
    e, l = spark.createDataFrame([(15, 1)], schema), spark.createDataFrame([(5, 9), (15, 1)], schema)
    bound = bind_subset(letters(W, e=(e, []), l=(l, [])), e, l, W, ["k"], [0, 1])
    assert [tuple(r) for r in bound.orderBy("idx").select("bound_0", "bound_1").collect()] == [(1, 1), (1, 0)]


def test_null_keys_are_keys(spark):
    schema = "tms BIGINT, k INT"
    e, l = spark.createDataFrame([(5, None)], schema), spark.createDataFrame([(5, None), (5, 1)], schema)
    assert bind_subset(letters(W, e=(e, []), l=(l, [])), e, l, W, ["k"], [0]).first()["bound_0"] == 1
