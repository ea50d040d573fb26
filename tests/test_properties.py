"""Property checks: what passes, what is falsified, what stays undecided."""

from __future__ import annotations

from functools import partial

import pytest
from conftest import rows

from pyspark.sql import functions as F

from tidemark.operators import generators as g
from tidemark.operators.atoms import foreach_element
from tidemark.operators.temporal import always, now
from tidemark.operators.windows import Windows
from tidemark.plans.pollution import pollution1
from tidemark.plans.properties import PROPERTIES, int_rows, sensor_rows
from tidemark.plans.property import CASE, Property, for_all_cases

ALWAYS_TRUE = [n for n in PROPERTIES if n != "prop_danger_never_safe_fails"]


def cases(spark, n=12):
    return g.cases_from(spark.range(n), "id")


@pytest.mark.parametrize("name", ALWAYS_TRUE)
def test_holds_in_every_case(spark, name):
    got = rows(PROPERTIES[name](cases(spark)))
    assert got == [(i, "True", True) for i in range(12)]


def test_the_falsifiable_one_is_falsified(spark):
    assert "False" in {r["verdict"] for r in PROPERTIES["prop_danger_never_safe_fails"](cases(spark)).collect()}


def test_thirteen():
    assert len(PROPERTIES) == 13


def non_negative(cut=Windows(100), n=5, **more):
    return Property(
        cut, always(now("ok"), n), output_atoms=[foreach_element("ok", F.col("value") >= 0)], **more
    )


def test_a_wrong_pipeline_is_caught(spark):
    some = cases(spark)
    got = for_all_cases(non_negative(), int_rows(some), lambda df: df, some)
    assert {r["verdict"] for r in got.collect()} == {"False"}


def test_too_few_letters_are_undecided_and_pass(spark):
    some = cases(spark)
    got = for_all_cases(non_negative(n=50), int_rows(some), lambda df: df.where("value >= 0"), some)
    assert rows(got) == [(i, "Undecided", True) for i in range(12)]


def test_letter_cap_leaves_the_rest_unread(spark):
    some = cases(spark)
    got = for_all_cases(non_negative(max_letters=3), int_rows(some), lambda df: df.where("value >= 0"), some)
    assert {r["verdict"] for r in got.collect()} == {"Undecided"}


def test_no_cap_by_default(spark):
    """A violation after letter 100 counts; a cap that is asked for hides it."""
    rows_ = spark.createDataFrame([(1, 10 * i, -1 if i == 120 else 1) for i in range(200)], "case_id BIGINT, tms BIGINT, value INT")
    source = rows_.withColumn("ts", F.timestamp_millis("tms"))
    some = spark.createDataFrame([(1,)], "case_id BIGINT")
    assert rows(for_all_cases(non_negative(Windows(10), 150), source, lambda df: df, some)) == [(1, "False", False)]
    assert rows(for_all_cases(non_negative(Windows(10), 150, max_letters=100), source, lambda df: df, some)) == [(1, "Undecided", True)]


def test_windows_that_start_long_before_the_data_are_refused(spark):
    """Every row violates the assertion, but all letters the verdict looks at lie in 1970."""
    start = 1704067200000
    rows_ = spark.createDataFrame([(1, start + 100 * i, -1) for i in range(20)], "case_id BIGINT, tms BIGINT, value INT")
    source = rows_.withColumn("ts", F.timestamp_millis("tms"))
    some = spark.createDataFrame([(1,)], "case_id BIGINT")
    with pytest.raises(ValueError, match="start_ms"):
        for_all_cases(non_negative(Windows(3_600_000)), source, lambda df: df, some)
    assert rows(for_all_cases(non_negative(Windows(100, start_ms=start)), source, lambda df: df, some)) == [(1, "False", False)]


def test_case_without_output_is_undecided(spark):
    some = cases(spark)
    got = for_all_cases(non_negative(), int_rows(some), lambda df: df.where("case_id <> 4 AND value >= 0"), some)
    assert rows(got.where("verdict <> 'True'")) == [(4, "Undecided", True)]


def test_cases_do_not_mix(spark):
    """Sensor ids repeat in every case; the case id separates them."""
    some = cases(spark, 3)
    source = sensor_rows(some, 5, 10, 20, 5, 180.1, 1000.0)
    prop = Property(Windows(1000), always(now("few"), 5), output_atoms=[foreach_element("few", F.col("sensor_id") < 5)])
    assert rows(for_all_cases(prop, source, lambda df: pollution1(df, keys=CASE), some), "verdict") == [("True",)] * 3


@pytest.mark.parametrize("name", ["prop_filter_nonneg", "prop_time_monotone", "prop_driver_until_driver"])
def test_streaming_run_gives_the_same_verdicts(spark, name):
    some = cases(spark)
    assert rows(PROPERTIES[name](some, partial(for_all_cases, streaming=True))) == rows(PROPERTIES[name](some))
