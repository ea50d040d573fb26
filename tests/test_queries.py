"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest
from oracle import TESTDATA, connect, differences

import __spark_entry__ as entry_point
from suite import QUERIES, ORACLES
from suite.recorded import NAMES

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry_point_has_them_all():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["sensor_id", "idx", "verdict"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_recorded_properties_can_fail(name):
    """The verdicts of the oracle are not all the same, so a constant would not pass."""
    verdicts = connect(f"{TESTDATA}/sf0.01").execute(ORACLES[name]).df()["verdict"]
    assert verdicts.nunique() >= 2
