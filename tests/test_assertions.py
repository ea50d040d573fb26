from __future__ import annotations

import pandas as pd
import pytest
from conftest import rows

from pyspark.sql import functions as F

from tidemark.operators import atoms as A
from tidemark.operators.letters import letters
from tidemark.operators.reports import failing_examples, window_head
from tidemark.operators.sets import contained, minus, missing_per_letter, union_marked
from tidemark.operators.windows import Windows

W = Windows(100)
EMPTY, ONE = [], [0]


def holds(df, atom):
    """Value of an assertion on a whole table, seen as letter 0 next to a stream that has it."""
    spine = df.sparkSession.createDataFrame([(0,)], "tms BIGINT")
    word = letters(W, rows=(df, [atom]), clock=(spine, []))
    if word.count() == 0:  # an empty stream ends the word: take the empty value of the assertion
        empty = letters(W, rows=(df.unionByName(df.sparkSession.createDataFrame([(100, 0)], df.schema)), [atom]))
        return empty.where("idx = 0").first()[atom.name]
    return word.first()[atom.name]


@pytest.mark.parametrize(
    "values,make,expected",
    [
        (EMPTY, lambda: A.exists_element("h", F.lit(True)), False),
        (EMPTY, lambda: A.exists_element("h", F.lit(False)), False),
        (ONE, lambda: A.exists_element("h", F.lit(True)), True),
        (ONE, lambda: A.exists_element("h", F.lit(False)), False),
        (EMPTY, lambda: A.foreach_element("h", F.lit(True)), True),
        (EMPTY, lambda: A.foreach_element("h", F.lit(False)), True),
        (ONE, lambda: A.foreach_element("h", F.lit(True)), True),
        (ONE, lambda: A.foreach_element("h", F.lit(False)), False),
        (EMPTY, lambda: A.be_empty("h"), True),
        (EMPTY, lambda: A.be_non_empty("h"), False),
        (ONE, lambda: A.be_empty("h"), False),
        (ONE, lambda: A.be_non_empty("h"), True),
        ([1, 2], lambda: A.foreach_projection("h", F.col("value") * 2, lambda v: v > 2), False),
        ([1, 2], lambda: A.exists_projection("h", F.col("value") * 2, lambda v: v > 2), True),
        ([1, 2], lambda: A.foreach_context("h", {1, 2, 3}, lambda s: F.col("value").isin(*s)), True),
        ([1, 4], lambda: A.exists_context("h", {2, 3}, lambda s: F.col("value").isin(*s)), False),
        ([None, 1], lambda: A.foreach_element("h", F.col("value") > 0), False),
        ([None], lambda: A.exists_element("h", F.col("value") > 0), False),
    ],
)
def test_assertions(ints, values, make, expected):
    assert holds(ints(values), make()) is expected


def test_ten_assertions_are_one_aggregation(ints):
    atoms = [A.foreach_element(f"h{i}", F.col("value") > i - 5) for i in range(10)]
    word = letters(W, rows=(ints(range(1, 11)), atoms))
    assert [word.first()[f"h{i}"] for i in range(10)] == [i - 5 < 1 for i in range(10)]


def test_pandas_predicate_as_escape_hatch(ints):
    @F.pandas_udf("boolean")
    def even(v: pd.Series) -> pd.Series:
        return v % 2 == 0

    assert holds(ints([2, 4]), A.foreach_element("h", even("value"))) is True
    assert holds(ints([2, 3]), A.foreach_element("h", even("value"))) is False


XS, YS, ZS = list(range(1, 11)), list(range(5, 16)), list(range(1, 6))


def test_minus(ints):
    assert rows(minus(ints(XS), ints(YS)), "value") == [(1,), (2,), (3,), (4,)]


def test_minus_keeps_surviving_duplicates_and_compares_null(ints):
    left, other = ints([1, 1, 2, 2, 3, None]), ints([2, None])
    assert rows(minus(left, other), "value") == [(1,), (1,), (3,)]
    assert rows(left.subtract(other), "value") == [(1,), (3,)]
    assert rows(left.exceptAll(other), "value") == [(1,), (1,), (2,), (3,)]


def test_minus_compares_the_time_too(ints):
    assert rows(minus(ints([1], tms=0), ints([1], tms=1)), "value") == [(1,)]
    assert minus(ints([1], tms=0), ints([1], tms=1), on=["value"]).count() == 0


def is_subset(left, other):
    return missing_per_letter(W.assign(left), W.assign(other), ["value"]).count() == 0


@pytest.mark.parametrize(
    "left,other,expected",
    [(EMPTY, EMPTY, True), (EMPTY, XS, True), (ZS, XS, True), (XS, XS, True), ([1, 1], XS, True),
     (XS, EMPTY, False), (XS, YS, False), (YS, XS, False)],
)
def test_subset(ints, left, other, expected):
    assert is_subset(ints(left), ints(other)) is expected


def test_subset_counts_per_letter(spark):
    left = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (150, 3)], "tms BIGINT, value INT")
    other = spark.createDataFrame([(10, 2), (110, 3), (110, 1)], "tms BIGINT, value INT")
    assert rows(missing_per_letter(W.assign(left), W.assign(other), ["value"])) == [(0, 1)]


def test_contained_and_union_marked(ints):
    assert rows(contained(ints([1, 2, 2, None]), ints([2, None, 7]), "there", ["value"]), "value", "there") == [
        (None, True), (1, False), (2, True), (2, True)]
    assert rows(union_marked(ints([1]), ints([2])), "value", "is_left") == [(1, True), (2, False)]


def test_failing_examples_are_the_first_four(ints):
    got = failing_examples(ints([9, 1, 8, 7, 6, 5, 2, None]), W, F.col("value") < 3, ["value"])
    assert rows(got, "rank", "value") == [(1, None), (2, 5), (3, 6), (4, 7)]


def test_window_head_counts_all_rows(ints):
    assert rows(window_head(ints(range(20)), W, ["value"]), "n_rows", "rank", "value") == [
        (20, i + 1, i) for i in range(5)]
