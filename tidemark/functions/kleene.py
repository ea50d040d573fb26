"""Three-valued logic on TINYINT codes: False -1, Undecided 0, True 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALSE, UNDECIDED, TRUE = -1, 0, 1


def code(value: int) -> Column:
    return F.lit(value).cast("tinyint")


def decide(holds: Column) -> Column:
    """Code of a two-valued condition; NULL counts as "does not hold"."""
    return F.when(holds, code(TRUE)).otherwise(code(FALSE))


def conj(*values: Column) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def disj(*values: Column) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def implies(a: Column, b: Column) -> Column:
    return F.greatest((-a).cast("tinyint"), b)


def verdict_name(value: Column) -> Column:
    """True / False / Undecided."""
    return F.when(value == TRUE, "True").when(value == FALSE, "False").otherwise("Undecided")
