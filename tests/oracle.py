"""Comparing a Spark result with the same query in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same rows, otherwise what differs."""
    mine = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    mine, theirs = normal(mine), normal(theirs)
    kinds = {c: (mine[c].dtype, theirs[c].dtype) for c in mine if mine[c].dtype.kind != theirs[c].dtype.kind}
    if kinds:
        return f"types {kinds}"
    wrong = ~((mine == theirs) | (mine.isna() & theirs.isna()))
    bad = wrong.any(axis=1)
    if bad.any():
        return f"{int(bad.sum())} of {len(mine)} rows differ:\n{mine[bad].head(5)}\n{theirs[bad].head(5)}"
    return None
