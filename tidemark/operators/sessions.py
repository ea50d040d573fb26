"""Windows that depend on the rows: a new one begins after a gap in time.

Numbering the windows of a case needs its times in order. They are made distinct first (combined map-side)
and cut into blocks of ``block_ms``. Within a block the starts are counted locally; of every block only a
summary (first and last time, number of starts) goes into the scan over the blocks of a case. So a case
that holds most of the data is as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.windows import Discretizer

DAY_MS = 86_400_000


def gap_numbers(df: DataFrame, gap_ms: int, by: Sequence[str] = (), tms: str = "tms", block_ms: int = DAY_MS) -> DataFrame:
    """``by, tms, number``: for every distinct time of a case the number of its window, from 0.

    A window begins where the time before is more than ``gap_ms`` earlier.
    """
    times = df.select(*by, tms).where(F.col(tms).isNotNull()).distinct()
    blocks = times.withColumn("_block", F.floor(F.col(tms) / F.lit(block_ms)))
    inside = W.partitionBy(*by, "_block").orderBy(tms)
    before = F.lag(tms).over(inside)
    marked = blocks.withColumn("_starts", F.coalesce(F.col(tms) - before > F.lit(gap_ms), F.lit(False)).cast("bigint"))
    local = marked.withColumn("_local", F.sum("_starts").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))

    summary = marked.groupBy(*by, "_block").agg(
        F.min(tms).alias("_first"), F.max(tms).alias("_last"), F.sum("_starts").alias("_count")
    )
    along = W.partitionBy(*by).orderBy("_block")
    # Whether a block's first time starts a window; the first block of a case does not count as a start.
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(along) > F.lit(gap_ms), F.lit(False)).cast("bigint")
    opened = summary.withColumn("_opens", opens)
    ahead = F.sum(F.col("_count") + F.col("_opens")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    bases = opened.withColumn("_base", ahead - F.col("_count"))
    on = [local[c].eqNullSafe(bases[c]) for c in [*by, "_block"]]
    joined = local.join(bases, on)
    return joined.select(*[local[c] for c in by], local[tms], (F.col("_base") + F.col("_local")).alias("number"))


@dataclass(frozen=True)
class GapWindows(Discretizer):
    """Windows of a case (``by``) that end where nothing comes for more than ``gap_ms``.

    Rows without a time are in no window. Every window has rows. Its start does not follow from its number,
    so ``w_start`` is NULL; take the smallest time of its rows as an assertion instead. Two streams are cut
    each by its own gaps.
    """

    gap_ms: int
    by: tuple[str, ...] = ()
    block_ms: int = DAY_MS

    def __post_init__(self) -> None:
        if self.gap_ms < 0 or self.block_ms <= 0:
            raise ValueError("the gap must not be negative and blocks must be positive")

    def panes(self, df: DataFrame, tms: str = "tms") -> DataFrame:
        numbers = gap_numbers(df, self.gap_ms, self.by, tms, self.block_ms)
        keys = [*self.by, tms]
        renamed = numbers.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)], F.col("number").alias("_pane"))
        on = [df[c].eqNullSafe(renamed[f"_key_{i}"]) for i, c in enumerate(keys)]
        return df.join(renamed, on).select(*[df[c] for c in df.columns], "_pane")

    def start_of(self, idx: Column) -> Column:
        return F.lit(None).cast("bigint")
