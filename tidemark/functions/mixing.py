"""Deterministic pseudo-random numbers from row identifiers.

``rand()`` depends on partitioning and on retries; a hash of the identifiers gives the same rows on
every run, on every cluster layout and after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier, increment and modulus of each linear step; every product fits a BIGINT.
STEPS = ((48271, 12345, 2147483647), (40692, 104729, 2147483587), (69621, 7919, 2147483629))
MODULUS = STEPS[-1][2]
FOLD = 15


def mix(x: Column) -> Column:
    """Scramble a non-negative BIGINT below 2**47 into [0, MODULUS).

    Linear steps alone keep neighbours in step, so the high bits are folded into the low ones after
    the first of them.
    """
    for i, (multiplier, increment, modulus) in enumerate(STEPS):
        x = (x * F.lit(multiplier) + F.lit(increment)) % F.lit(modulus)
        if i == 0:
            x = x.bitwiseXOR(F.shiftright(x, FOLD))
    return x


def pick_int(h: Column, low: int, high: int) -> Column:
    """Whole number in low..high (both inclusive)."""
    return F.lit(low).cast("bigint") + h % F.lit(high - low + 1)


def pick_tenths(h: Column, low: float, high: float) -> Column:
    """Number in low..high in steps of 0.1 (exact in tenths, so that engines agree)."""
    lo, hi = round(low * 10), round(high * 10)
    return (F.lit(lo).cast("bigint") + h % F.lit(hi - lo + 1)) / F.lit(10.0)
