"""Registered queries against their SQL in DuckDB, on a given table."""

import pytest
from oracle import TESTDATA, connect

import __spark_entry__ as entry_point
from tidemark.llm.queries import ORACLES, QUERIES

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = con.execute(ORACLES[name])
    assert sorted(d[0] for d in theirs.description) == columns
    place = [[d[0] for d in theirs.description].index(c) for c in columns]
    assert sorted(map(tuple, mine.select(columns).collect()), key=str) == sorted((tuple(r[i] for i in place) for r in theirs.fetchall()), key=str)


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and {*QUERIES, "pipeline"} <= set(entry_point.queries())
