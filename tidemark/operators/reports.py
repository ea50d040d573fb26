"""Bounded per-letter reports: counter-examples and window heads.

``row_number() <= n`` lets Spark cut every partition to n rows per letter before the shuffle
(window group limit), so a letter that holds most of the data is not gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.sets import absent_keys
from tidemark.operators.windows import Discretizer

EXAMPLES = 4
SAMPLES = 5


def first_rows(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first n rows of every letter, numbered ``rank`` 1..n."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by, "idx").orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def failing_examples(
    df: DataFrame,
    windows: Discretizer,
    predicate: Column,
    order: Sequence[str],
    n: int = EXAMPLES,
    by: Sequence[str] = (),
    tms: str = "tms",
) -> DataFrame:
    """Up to n rows per letter that do not satisfy the predicate (NULL does not)."""
    failing = df.where(~F.coalesce(predicate, F.lit(False)))
    return first_rows(windows.assign(failing, tms), n, order, by)


def subset_examples(
    left: DataFrame, other: DataFrame, keys: Sequence[str], n: int = EXAMPLES, by: Sequence[str] = ()
) -> DataFrame:
    """Up to n keys per letter of ``left`` (``by..., idx, keys...``) that the letter of ``other`` lacks, in key order."""
    return first_rows(absent_keys(left, other, keys, by), n, keys, by)


def window_head(
    df: DataFrame,
    windows: Discretizer,
    order: Sequence[str],
    n: int = SAMPLES,
    by: Sequence[str] = (),
    tms: str = "tms",
) -> DataFrame:
    """The first n rows of every letter, with the number of rows the letter has."""
    rows = windows.assign(df, tms)
    counts = rows.groupBy(*by, "idx").agg(F.count(F.lit(1)).alias("n_rows"))
    return first_rows(rows, n, order, by).join(counts, [*by, "idx"])
