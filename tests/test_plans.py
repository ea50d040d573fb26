"""Physical plans: what must hold for the jobs to scale."""

from __future__ import annotations

import re

import pytest

from pyspark.sql import functions as F

import suite
from suite.letters import HOURLY
from tidemark.operators.atoms import exists_element
from tidemark.operators.letters import letters
from tidemark.operators.reports import failing_examples
from tidemark.operators.sets import contained, minus
from tidemark.plans.pollution import pollution1
from tidemark.sources.tables import sensors

SF = "/root/testdata/sf0.001"
EAGER = ("stream_", "record_", "prop_", "src_", "sink_")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Settings for one test."""
    before = {}

    def put(**settings):
        for key, value in settings.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def large(conf):
    """Plans as for inputs too large to broadcast, without adaptive wrappers."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")


@pytest.mark.parametrize("name", [n for n in suite.QUERIES if not n.startswith(EAGER)])
def test_no_nested_loops_and_no_python(spark, large, name):
    text = plan(suite.QUERIES[name](spark, SF))
    assert not re.search("NestedLoop|Cartesian|Python|Arrow|MapInPandas", text)
    assert not re.search(r"BroadcastHashJoin|BroadcastExchange", text)


def test_letters_read_their_input_once(spark, large):
    df = letters(HOURLY, ["sensor_id"], rows=(sensors(spark, SF), [exists_element("h", F.col("concentration") > 400)]))
    text = plan(df.select("sensor_id", "idx", "h"))
    assert text.count("FileScan") == 1 and text.count("ReusedExchange") == 1


@pytest.mark.parametrize("name", ["t_always", "t_until", "case_verdict", "t_nested"])
def test_formulas_read_each_side_once(spark, large, name):
    text = plan(suite.QUERIES[name](spark, SF))
    assert text.count("FileScan") <= (3 if name == "case_verdict" else 2)  # the cases are a third input
    assert len(re.findall(r"- Window ", text)) == (2 if name == "t_nested" else 1)


def test_rows_are_combined_before_every_shuffle_of_them(spark, large):
    text = plan(pollution1(sensors(spark, SF), "1 hour"))
    assert "partial_max" in text and text.count("Exchange hashpartitioning") == 1


def test_only_needed_columns_are_read(spark):
    text = plan(pollution1(sensors(spark, SF), "1 hour"))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_event_type_filter_reaches_the_scan(spark):
    assert "EqualTo(event_type,purchase)" in plan(suite.QUERIES["hourly_max"](spark, SF))


def test_failing_examples_are_cut_before_the_shuffle(spark, large):
    found = failing_examples(sensors(spark, SF), HOURLY, F.col("concentration") <= 300, ["tms"])
    text = plan(found)
    assert re.search(r"WindowGroupLimit .*Final.*\n(.*\n)*.*Exchange(.*\n)*.*WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize("operation", ["minus", "contained"])
def test_one_hot_row_value_is_split(spark, conf, operation):
    """A third of the left rows are equal: adaptive execution splits their partition."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    )
    n = 300_000
    left = spark.range(0, n, 1, 16).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    other = spark.range(0, n, 5, 16).select(F.col("id").alias("k"))
    if operation == "minus":
        df = minus(left, other, on=["k"])
        assert df.count() == n - left.join(other, "k", "left_semi").count()
    else:
        df = contained(left, other, "there", ["k"])
        assert df.where("there").count() == left.join(other, "k", "left_semi").count()
    df.write.format("noop").mode("overwrite").save()
    result = df.groupBy().agg(F.sum("id"))
    result.collect()
    assert "skew=true" in plan(result)


@pytest.mark.parametrize("name", ["pollution1_sliding", "pollution2", "pollution3"])
def test_rows_are_combined_before_they_are_copied_to_windows(spark, large, name):
    """Below every Expand lies a partial aggregate: only pane results are copied."""
    lines = plan(suite.QUERIES[name](spark, SF)).splitlines()
    assert not any("collect_list" in line for line in lines)
    expands = [i for i, line in enumerate(lines) if "Expand" in line]
    assert expands
    for i in expands:
        below = "\n".join(lines[i : i + 12])
        assert "HashAggregate" in below.split("FileScan")[0]


def test_ends_of_words_are_hash_aggregated(spark, large):
    assert "SortAggregate" not in plan(suite.QUERIES["t_always"](spark, SF))


@pytest.mark.parametrize("name", ["alerts_broadcast_subset", "bound_alert_liveness"])
def test_membership_does_not_join_rows(spark, large, name):
    """Rows are grouped; what is joined has one row per letter."""
    text = plan(suite.QUERIES[name](spark, SF))
    for part in text.split("SortMergeJoin")[1:]:
        assert "idx" in part.split("]")[0]
