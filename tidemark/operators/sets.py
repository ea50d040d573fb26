"""Difference, membership and subset over whole rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _distinct_right(other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The right side of a membership join, each row once (duplicates are combined map-side)."""
    return other.select(
        F.xxhash64(*columns).alias("_key"), *[F.col(c).alias(f"_other_{c}") for c in columns]
    ).distinct()


def _membership(left: DataFrame, other: DataFrame, columns: Sequence[str], how: str, mark: str | None = None) -> DataFrame:
    """Join on null-safe equality of ``columns``.

    The hash key makes Spark shuffle both sides directly below the join (the right side is
    otherwise already grouped by the columns), which is the shape in which adaptive execution
    splits a partition that one hot row value fills. Spark broadcasts the right side only when its
    measured size allows that.
    """
    right = _distinct_right(other, columns)
    if mark is not None:
        right = right.withColumn(mark, F.lit(True))
    on = F.col("_left_key") == F.col("_key")
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    joined = left.withColumn("_left_key", F.xxhash64(*columns)).join(right, on, how)
    return joined.drop("_left_key", "_key", *[f"_other_{c}" for c in columns])


def minus(left: DataFrame, other: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Every occurrence of a row of ``left`` that is absent from ``other``.

    One occurrence in ``other`` removes all duplicates; duplicates that survive are kept. This is
    neither ``subtract`` (removes duplicates) nor ``exceptAll`` (counts occurrences). ``on`` names
    the columns that identify a row, all of them by default.
    """
    return _membership(left, other, list(on or left.columns), "left_anti")


def contained(left: DataFrame, other: DataFrame, name: str, on: Sequence[str]) -> DataFrame:
    """``left`` with a boolean column: is the row's key among the keys of ``other``?"""
    marked = _membership(left, other, list(on), "left_outer", mark=name)
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def union_marked(left: DataFrame, other: DataFrame, mark: str = "is_left") -> DataFrame:
    """Both tables in one, each row marked with where it comes from."""
    return left.withColumn(mark, F.lit(True)).unionByName(other.withColumn(mark, F.lit(False)))


def missing_per_letter(left: DataFrame, other: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per letter, how many distinct keys of ``left`` are absent from the same letter of ``other``.

    Both tables carry ``by..., idx``. A letter is a subset iff its count is 0 (letters not listed
    miss nothing). Duplicates do not matter here, so the two tables are put together and grouped:
    one shuffle, combined map-side, and no join that a frequent key could skew.
    """
    return absent_keys(left, other, keys, by).groupBy(*by, "idx").agg(F.count(F.lit(1)).alias("n_missing"))


def absent_keys(left: DataFrame, other: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., idx, keys...``: the distinct keys of ``left`` that the same letter of ``other`` does not have."""
    columns = [*by, "idx", *keys]
    both = union_marked(left.select(*columns), other.select(*columns))
    return both.groupBy(*columns).agg(F.bool_and("is_left").alias("absent")).where("absent").drop("absent")
