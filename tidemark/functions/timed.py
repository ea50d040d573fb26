"""Event-time helpers: ``ts`` is the event time as TIMESTAMP, ``tms`` the same in epoch milliseconds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_timestamp(df: DataFrame, ts: str = "ts", tms: str = "tms") -> DataFrame:
    """Attach each row's event time in epoch milliseconds.

    Rows that leave a window carry ``window_time`` (the last instant of the window), so a
    one-second window's output is stamped with that second's last millisecond.
    """
    return df.withColumn(tms, F.unix_millis(F.col(ts)))


def from_millis(tms: Column) -> Column:
    return F.timestamp_millis(tms)


def field_from_event_time(
    df: DataFrame, field: str, assign: Callable[[Column], Column] = lambda tms: tms, tms: str = "tms"
) -> DataFrame:
    """Overwrite a payload field with a value computed from the row's event time."""
    return df.withColumn(field, assign(F.col(tms)))


def timed_order(df: DataFrame, values: Sequence[str], tms: str = "tms") -> DataFrame:
    """Order timed rows by value first, then by time."""
    return df.orderBy(*values, tms)
