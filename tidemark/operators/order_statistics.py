"""Exact order statistics of windows and letters: functions that partial results can not be merged for.

The value at a rank is searched for by ranges: count the rows per value (combined map-side), then cut the
range of values that is left of each group into bins, keep the bin that holds the rank, and repeat while a
group has more than ``few`` different values left. Bins are counted, so a group with most of all rows is
many tasks, and only bounds and counts are kept per group; the driver sees one number a round. Where groups
are small there is no round at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.event_windows import window_columns
from tidemark.operators.windows import Discretizer
from tidemark.session import scratch_path

BINS = 256
# Different values of one group that one task may put in order.
FEW = 10_000


def _same(names: Sequence[str], left: str, right: str) -> Column:
    """NULL keys are a group too."""
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return on


def _inside(counts: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values of each group that lie within its bounds, for every rank sought."""
    on = _same(by, "c", "b") & F.col("c._value").between(F.col("b._lo"), F.col("b._hi"))
    kept = [F.col(f"c.{name}") for name in (*by, "_value", "_n")] + [F.col(f"b.{name}") for name in ("_rank", "_below", "_lo", "_hi")]
    return counts.alias("c").join(bounds.alias("b"), on).select(*kept)


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Bin of a value, in order of the values; the ends of the range always are in different ones."""
    # Halves, as a range may be larger than the largest double. Infinite ends leave the others in one bin.
    place = F.floor((value / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)
    endless = (lo == F.lit(float("-inf"))) | (hi == F.lit(float("inf")))
    middle = F.when(endless, F.lit(1)).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)))
    return F.when(value == lo, F.lit(0)).when(value == hi, F.lit(BINS)).otherwise(middle).cast("int")


def _narrowed(counts: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounds of the bin that holds each rank, and how many rows of the group lie below it."""
    keys = [*by, "_rank", "_below"]
    binned = _inside(counts, bounds, by).withColumn("_bin", _bin(F.col("_value"), F.col("_lo"), F.col("_hi")))
    bins = binned.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"), F.count(F.lit(1)).alias("_values")
    )
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bin")) + F.col("_below")
    holding = bins.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    return holding.select(*by, "_rank", (F.col("_upto") - F.col("_n")).alias("_below"), "_lo", "_hi", "_values")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values_at_ranks(df: DataFrame, value: str, ranks: Mapping[str, Column], by: Sequence[str], few: int = FEW) -> DataFrame:
    """``by..., n_rows`` and a column for each rank: the value of that rank (from 1) in the group.

    A rank is an expression of ``n_rows``. Values are doubles; rows whose value is NULL or NaN do not count, and
    a group without others is not in the result. A rank outside 1..n_rows gives NULL.
    """
    counts = df.select(*by, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL AND NOT isnan(_value)")
    # -0.0 and 0.0 are one value.
    counts = _written(counts.groupBy(*by, (F.col("_value") + F.lit(0.0)).alias("_value")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    groups = counts.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"), F.count(F.lit(1)).alias("_values")
    )
    groups = _written(groups, "value-groups")
    sought = F.array_distinct(F.array(*[r.cast("bigint") for r in ranks.values()]))
    bounds = groups.select(*by, F.explode(sought).alias("_rank"), F.lit(0).cast("bigint").alias("_below"), "_lo", "_hi", "_values", "n_rows")
    bounds = bounds.where("_rank BETWEEN 1 AND n_rows").drop("n_rows")
    settled = None
    while bounds.where(F.col("_values") > few).limit(1).count():
        done = bounds.where(F.col("_values") <= few)
        settled = done if settled is None else settled.unionByName(done)
        bounds = _written(_narrowed(counts, bounds.where(F.col("_values") > few), by), "value-bounds")
    bounds = bounds if settled is None else bounds.unionByName(settled)
    keys = [*by, "_rank", "_below"]
    ordered = _inside(counts, bounds, by).withColumn("_upto", F.sum("_n").over(W.partitionBy(*keys).orderBy("_value")) + F.col("_below"))
    found = ordered.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    at = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    joined = groups.alias("g").join(at.alias("a"), _same(by, "g", "a"), "left").select(*[F.col(f"g.{c}") for c in (*by, "n_rows")], "a._at")
    return joined.select(*by, "n_rows", *[F.try_element_at("_at", rank.cast("bigint")).alias(name) for name, rank in ranks.items()])


def window_median(df: DataFrame, value: str, size: str, slide: str | None = None, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``ts, w_end, by..., n_rows, median`` per window and key that has values: the mean of the two middle ones."""
    rows = df.select(F.window(ts, size, slide).alias("w"), *by, value)
    middle = {"_low": F.floor((F.col("n_rows") + 1) / 2), "_high": F.floor((F.col("n_rows") + 2) / 2)}
    found = values_at_ranks(rows.select(*window_columns(), *by, value), value, middle, ["ts", "w_end", *by])
    return found.select("ts", "w_end", *by, "n_rows", (F.col("_low") / 2 + F.col("_high") / 2).alias("median"))


def letter_percentile(
    df: DataFrame, windows: Discretizer, value: str, share: float, by: Sequence[str] = (), tms: str = "tms"
) -> DataFrame:
    """``by..., idx, n_rows, percentile`` of the letters that have values: the smallest value that at least
    ``share`` of the letter's rows do not exceed."""
    if not 0 < share <= 1:
        raise ValueError("a share is above 0 and at most 1")
    rank = {"percentile": F.greatest(F.ceil(F.col("n_rows") * F.lit(share)), F.lit(1))}
    return values_at_ranks(windows.assign(df, tms), value, rank, [*by, "idx"])
