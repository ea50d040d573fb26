"""Synthetic windowed events, many test cases in one table keyed by ``case_id``.

A generator is a table of rows ``case_id, idx, row, h``: window ``idx`` of the case contains row
number ``row``; ``h`` is a hash of the three from which payload values are picked. A window without
rows is simply absent. Cases come from a real table, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.mixing import mix
from tidemark.operators.windows import Windows
from tidemark.session import spread


def cases_from(df: DataFrame, key: str) -> DataFrame:
    """One test case per distinct value of a BIGINT key."""
    return df.select(F.col(key).alias("case_id")).distinct()


def _with_hash(df: DataFrame, name: str, *parts: Column) -> DataFrame:
    """Chain of hashes, one projection each so that no expression is repeated."""
    df = df.withColumn(name, mix(parts[0]))
    for part in parts[1:]:
        df = df.withColumn(name, mix(F.col(name) + part))
    return df


def always_windows(cases: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Windows 0..n-1 of every case: ``case_id, idx, wh``."""
    windows = cases.select("case_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1))).alias("idx"))
    return _with_hash(windows, "wh", F.col("case_id") + F.lit(seed), F.col("idx"))


def eventually_window(cases: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """One window per case, at a position below n that depends on the case."""
    placed = _with_hash(cases, "_p", F.col("case_id") + F.lit(seed)).select("case_id", (F.col("_p") % F.lit(n)).alias("idx"))
    return _with_hash(placed, "wh", F.col("case_id") + F.lit(seed), F.col("idx"))


def until_windows(cases: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Windows 0..p with p < n: ``released`` is false before window p and true at it."""
    placed = _with_hash(cases, "_p", F.col("case_id") + F.lit(seed)).withColumn("_p", F.col("_p") % F.lit(n))
    windows = placed.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_p"))))
    windows = windows.withColumn("released", F.col("idx") == F.col("_p")).drop("_p")
    return _with_hash(windows, "wh", F.col("case_id") + F.lit(seed), F.col("idx"))


def rows_n_to_m(windows: DataFrame, n: int, m: int) -> DataFrame:
    """Between n and m rows in each window (the number depends on the window)."""
    count = F.lit(n).cast("bigint") + F.col("wh") % F.lit(m - n + 1)
    rows = spread(windows, "case_id", "idx").withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), count)))
    return _with_hash(rows.withColumn("h", F.col("wh") + F.col("row")), "h", F.col("h")).drop("wh")


def rows_n(windows: DataFrame, n: int) -> DataFrame:
    """Exactly n rows in each window."""
    return rows_n_to_m(windows, n, n)


def later(rows: DataFrame, n: int) -> DataFrame:
    """The same windows, n windows later."""
    return rows.withColumn("idx", F.col("idx") + F.lit(n))


def concat(first: DataFrame, second: DataFrame, length: int) -> DataFrame:
    """Windows of ``second`` after the ``length`` windows of ``first``."""
    return first.unionByName(later(second, length))


def concat_after(first: DataFrame, lengths: DataFrame, second: DataFrame) -> DataFrame:
    """Windows of ``second`` after those of ``first``, whose number differs by case: ``lengths`` has
    ``case_id, n_windows`` (empty windows count). A case without a length has the first part only."""
    moved = second.join(lengths, "case_id").withColumn("idx", F.col("idx") + F.col("n_windows")).drop("n_windows")
    return first.unionByName(moved)


def window_counts(windows: DataFrame) -> DataFrame:
    """``case_id, n_windows``: up to the last window of each case."""
    return windows.groupBy("case_id").agg((F.max("idx") + F.lit(1)).alias("n_windows"))


def merge(first: DataFrame, second: DataFrame, first_rows_max: int) -> DataFrame:
    """Rows of both in the same windows; row numbers of ``second`` continue after the first's."""
    return first.unionByName(second.withColumn("row", F.col("row") + F.lit(first_rows_max)))


def place_tumbling(rows: DataFrame, windows: Windows) -> DataFrame:
    """Give every row an event time inside its window, uniform over the window's milliseconds."""
    offset = mix(F.col("h") + F.lit(1)) % F.lit(windows.size_ms)
    return _timed(rows, windows.start_of(F.col("idx")) + offset)


def _timed(rows: DataFrame, tms: Column) -> DataFrame:
    return rows.withColumn("tms", tms.cast("bigint")).withColumn("ts", F.timestamp_millis("tms"))
