"""Assertions that tie the rows of one letter to a later letter.

"Every key of letter i is among the keys of letter i + o" for a few offsets o. The keys of every letter
are made distinct first (combined map-side); only these are copied to each letter in which they are
looked for, and grouped by (letter, key) with a bit per offset. There is no join of rows.

"Every key of letter i has a row at least as high in letter i + o" needs of all rows of a letter and key only
the highest value of each side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kleene import FALSE, TRUE, UNDECIDED, code
from tidemark.operators.sets import union_marked
from tidemark.operators.windows import Discretizer


def bind_subset(
    letters: DataFrame,
    early: DataFrame,
    late: DataFrame,
    windows: Discretizer,
    keys: Sequence[str],
    offsets: Sequence[int],
    by: Sequence[str] = (),
    prefix: str = "bound_",
    tms: str = "tms",
) -> DataFrame:
    """``letters`` with one three-valued column per offset: are all ``keys`` of ``early`` in letter
    ``idx`` found in ``late`` at letter ``idx + offset``?

    A letter without keys holds at every offset; an offset past the end of the word is Undecided.
    """
    if max(offsets) > 62 or min(offsets) < 0:
        raise ValueError("offsets must be 0..62")
    by = list(by)
    columns = [*by, "idx", *keys]
    both = union_marked(windows.assign(early, tms).select(*columns), windows.assign(late, tms).select(*columns), "_early")
    # Each key of a letter once, before it is copied to the letters in which it is looked for.
    once = both.groupBy(*columns).agg(F.bool_or("_early").alias("_early"), F.bool_or(~F.col("_early")).alias("_late"))
    here = F.when(F.col("_late"), F.array(F.struct(F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("want")))).otherwise(F.array())
    ahead = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(1 << o).cast("bigint").alias("want")) for o in offsets])
    copies = once.withColumn("_x", F.explode(F.concat(here, F.when(F.col("_early"), ahead).otherwise(F.array()))))
    placed = copies.select(*by, (F.col("idx") + F.col("_x.o")).alias("idx"), *keys, F.col("_x.want").alias("_want"))
    # A key that is there brings a row that wants nothing.
    groups = placed.groupBy(*columns).agg(F.bit_or("_want").alias("_want"), F.bool_or(F.col("_want") == 0).alias("_seen"))
    offset = F.array(*[F.when(F.col("_want").bitwiseAND(F.lit(1 << o)) != 0, F.lit(o)) for o in offsets])
    misses = groups.where(~F.col("_seen")).select(*by, "idx", F.explode(F.array_compact(offset)).alias("_offset"))
    return _with_misses(letters, misses, offsets, by, prefix)


def _with_misses(letters: DataFrame, misses: DataFrame, offsets: Sequence[int], by: list[str], prefix: str) -> DataFrame:
    """``letters`` with a value per offset; ``misses`` are the (later letter, offset) at which some key fails."""
    mask = F.bit_or(F.pow(F.lit(2), F.col("_offset")).cast("bigint"))
    per_letter = misses.groupBy(*by, (F.col("idx") - F.col("_offset")).alias("idx")).agg(mask.alias("_missed"))

    def value(offset: int) -> Column:
        missed = F.coalesce(F.col("_missed"), F.lit(0)).bitwiseAND(F.lit(1 << offset)) != 0
        return (
            F.when(F.col("idx") + F.lit(offset) > F.col("last_idx"), code(UNDECIDED))
            .when(missed, code(FALSE))
            .otherwise(code(TRUE))
            .alias(f"{prefix}{offset}")
        )

    joined = letters.join(per_letter, [*by, "idx"], "left")
    return joined.select(*letters.columns, *[value(o) for o in offsets])


def bind_reaches(
    letters: DataFrame,
    early: DataFrame,
    late: DataFrame,
    windows: Discretizer,
    keys: Sequence[str],
    value: str,
    offsets: Sequence[int],
    by: Sequence[str] = (),
    prefix: str = "bound_",
    tms: str = "tms",
) -> DataFrame:
    """``letters`` with one three-valued column per offset: does every key of ``early`` in letter ``idx`` have, in
    ``late`` at letter ``idx + offset``, a row whose ``value`` is at least all its values in letter ``idx``?

    For "at most" give negated values. Rows whose value is NULL or NaN ask for nothing and reach nothing.
    A letter without keys holds at every offset; an offset past the end of the word is Undecided.
    """
    if max(offsets) > 62 or min(offsets) < 0:
        raise ValueError("offsets must be 0..62")
    by = list(by)
    columns = [*by, "idx", *keys]

    def valued(df: DataFrame) -> DataFrame:
        rows = windows.assign(df, tms).select(*columns, F.col(value).cast("double").alias("_value"))
        return rows.where(F.col("_value").isNotNull() & ~F.isnan("_value"))

    both = union_marked(valued(early), valued(late), "_early")
    once = both.groupBy(*columns).agg(
        F.max(F.when(F.col("_early"), F.col("_value"))).alias("_need"),
        F.max(F.when(~F.col("_early"), F.col("_value"))).alias("_have"),
    )
    # The highest value of a letter goes to each letter in which it is to be reached; what is there stays.
    steps = F.array(F.lit(None).cast("int"), *[F.lit(o) for o in offsets])
    copies = once.withColumn("_o", F.explode(steps))
    placed = copies.where(F.when(F.col("_o").isNull(), F.col("_have").isNotNull()).otherwise(F.col("_need").isNotNull()))
    placed = placed.withColumn("idx", F.col("idx") + F.coalesce("_o", F.lit(0)))
    needs = [F.max(F.when(F.col("_o") == o, F.col("_need"))).alias(f"_need_{o}") for o in offsets]
    groups = placed.groupBy(*columns).agg(F.max(F.when(F.col("_o").isNull(), F.col("_have"))).alias("_there"), *needs)
    failed = [
        F.when(F.col(f"_need_{o}").isNotNull() & ~F.coalesce(F.col("_there") >= F.col(f"_need_{o}"), F.lit(False)), F.lit(o))
        for o in offsets
    ]
    misses = groups.select(*by, "idx", F.explode(F.array_compact(F.array(*failed))).alias("_offset"))
    return _with_misses(letters, misses, offsets, by, prefix)


def bound_columns(offsets: Sequence[int], prefix: str = "bound_") -> list[str]:
    return [f"{prefix}{o}" for o in offsets]
