"""Formula columns against the recursive definition, on random words."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.operators import temporal as T

SCHEMA = "case_id BIGINT, idx BIGINT, w_start BIGINT, last_idx BIGINT, a BOOLEAN, b BOOLEAN, c TINYINT"


def words(spark, n, longest, seed):
    rng = random.Random(seed)
    table, out = {}, []
    for case in range(n):
        length = rng.randint(1, longest)
        word = [(rng.random() < 0.7, rng.random() < 0.3, rng.choice([-1, 0, 1])) for _ in range(length)]
        table[case] = word
        out += [(case, i, i * 10, length - 1, *letter) for i, letter in enumerate(word)]
    return table, spark.createDataFrame(out, SCHEMA)


def code(x):
    return 1 if x else -1


def meaning(f, word, i):
    """Three-valued value of a formula at letter i; letters past the end are Undecided."""
    if i >= len(word):
        return 0
    kind = f[0]
    if kind == "a":
        return code(word[i][0])
    if kind == "b":
        return code(word[i][1])
    if kind == "c":
        return word[i][2]
    if kind == "next":
        return meaning(f[1], word, i + 1)
    if kind == "always":
        return min(meaning(f[1], word, i + k) for k in range(f[2]))
    if kind == "eventually":
        return max(meaning(f[1], word, i + k) for k in range(f[2]))
    if kind == "until":
        _, hold, release, n = f
        return max(
            min([meaning(release, word, i + j)] + [meaning(hold, word, i + k) for k in range(j)]) for j in range(n)
        )
    if kind == "and":
        return min(meaning(f[1], word, i), meaning(f[2], word, i))
    if kind == "or":
        return max(meaning(f[1], word, i), meaning(f[2], word, i))
    if kind == "implies":
        return max(-meaning(f[1], word, i), meaning(f[2], word, i))
    raise AssertionError(kind)


def build(f) -> T.Formula:
    kind = f[0]
    if kind in "ab":
        return T.now(kind)
    if kind == "c":
        return T.coded("c")
    if kind == "next":
        return T.next_(build(f[1]))
    if kind == "always":
        return T.always(build(f[1]), f[2])
    if kind == "eventually":
        return T.eventually(build(f[1]), f[2])
    if kind == "until":
        return T.until(build(f[1]), build(f[2]), f[3])
    left, right = build(f[1]), build(f[2])
    return {"and": left & right, "or": left | right, "implies": left >> right}[kind]


def check(spark, f, seed, block):
    table, df = words(spark, 60, 14, seed)
    got = {(r["case_id"], r["idx"]): r["value"] for r in T.evaluate(df, build(f), ["case_id"], block=block).collect()}
    expected = {(case, i): meaning(f, word, i) for case, word in table.items() for i in range(len(word))}
    assert got == expected


A, B, C = ("a",), ("b",), ("c",)
FORMULAS = [
    A,
    ("next", C),
    ("next", ("next", B)),
    ("always", A, 1),
    ("always", C, 3),
    ("always", A, 20),
    ("eventually", C, 4),
    ("eventually", B, 1),
    ("until", A, B, 1),
    ("until", A, B, 4),
    ("until", C, B, 5),
    ("until", A, C, 5),
    ("until", C, C, 3),
    ("until", C, C, 30),
    ("always", ("eventually", B, 2), 3),
    ("eventually", ("always", C, 2), 3),
    ("always", ("until", A, ("next", C), 3), 2),
    ("implies", A, ("eventually", ("and", B, C), 3)),
    ("or", ("always", A, 2), ("next", ("always", B, 2))),
]


@pytest.mark.parametrize("i", range(len(FORMULAS)))
def test_against_definition(spark, i):
    check(spark, FORMULAS[i], seed=i, block=[4096, 5, 3][i % 3])


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_do_not_change_values(spark, block):
    check(spark, ("always", ("until", C, B, 3), 2), seed=block, block=block)


LEAVES = st.sampled_from([A, B, C])
HORIZONS = st.integers(1, 6)
TREES = st.recursive(
    LEAVES,
    lambda kids: st.one_of(
        st.tuples(st.just("next"), kids),
        st.tuples(st.sampled_from(["always", "eventually"]), kids, HORIZONS),
        st.tuples(st.just("until"), kids, kids, HORIZONS),
        st.tuples(st.sampled_from(["and", "or", "implies"]), kids, kids),
    ),
    max_leaves=4,
)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(f=TREES, seed=st.integers(0, 10**6), block=st.sampled_from([2, 6, 4096]))
def test_random_formulas(spark, f, seed, block):
    check(spark, f, seed, block)


def test_bind_next(spark):
    _, df = words(spark, 20, 6, 3)
    formula = T.always(T.bind_next(lambda this, nxt: nxt("w_start") - this("w_start") == 10), 3)
    got = T.evaluate(df, formula, ["case_id"])
    assert got.where((F.col("idx") + 3 <= F.col("last_idx")) != (F.col("value") == 1)).count() == 0
    assert got.where("value = -1").count() == 0


def test_null_condition_does_not_hold(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, None, None, None)], SCHEMA)
    assert T.evaluate(df, T.now("a"), ["case_id"]).first()["value"] == -1


def test_case_verdict(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, -1), (2, 0, -1), (3, 0, 0)], "case_id BIGINT, idx BIGINT, value TINYINT")
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case_id BIGINT")
    assert rows(T.case_verdict(df, cases, ["case_id"])) == [
        (1, "True", True), (2, "False", False), (3, "Undecided", True), (4, "Undecided", True)]


def test_word_without_cases(spark):
    df = spark.createDataFrame([(i, i, 9, i != 7) for i in range(10)], "idx BIGINT, w_start BIGINT, last_idx BIGINT, a BOOLEAN")
    got = dict(rows(T.with_verdict(T.evaluate(df, T.always(T.now("a"), 3), block=4)), "idx", "verdict"))
    assert got == {**{i: "True" for i in range(5)}, 5: "False", 6: "False", 7: "False", 8: "Undecided", 9: "Undecided"}
