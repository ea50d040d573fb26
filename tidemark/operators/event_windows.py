"""Windowed aggregation of an event stream, keyed or global, tumbling or sliding.

A function of the rows of a window is given as aggregate columns (``sum``, ``avg``, ``max``, ...) or,
for sliding windows, as mergeable aggregates. They are combined from partial results on both sides of
the shuffle and kept incrementally in a streaming state, so no window is ever gathered in one place. A
global window is simply one without keys: its result is one group per window, and windows run in
parallel.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import Mergeable

_UNIT_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as ``3 hours``."""
    m = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", text)
    if not m or m[2] not in _UNIT_MS:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNIT_MS[m[2]]


def window_columns(window: str = "w") -> list[Column]:
    """Event time (last instant) and end (epoch milliseconds) of a window's result row."""
    return [F.window_time(window).alias("ts"), F.unix_millis(F.col(f"{window}.end")).alias("w_end")]


def window_aggregate(
    df: DataFrame,
    aggregates: dict[str, Column],
    size: str,
    slide: str | None = None,
    by: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """``ts, w_end, by..., aggregates``, one row per window and key that has rows.

    The result carries its window's last instant as ``ts``, so it can be windowed again; an equal
    ``size`` then groups the results of one window.
    """
    values = [column.alias(name) for name, column in aggregates.items()]
    grouped = df.groupBy(F.window(ts, size, slide).alias("w"), *by).agg(*values)
    return grouped.select(*window_columns(), *by, *aggregates)


def sliding_aggregate(
    df: DataFrame,
    aggregates: dict[str, Mergeable],
    size: str,
    slide: str,
    by: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """``ts, w_end, by..., aggregates`` per sliding window and key that has rows.

    Rows are aggregated once, per pane (the greatest common divisor of size and slide); only the
    panes' partial results are copied to the windows they belong to.
    """
    pane_ms = gcd(duration_ms(size), duration_ms(slide))
    partial = [c for name, a in aggregates.items() for c in a.partial(name)]
    names = [n for name, a in aggregates.items() for n in a.names(name)]
    panes = df.groupBy(F.window(ts, f"{pane_ms} milliseconds").alias("_pane"), *by).agg(*partial)
    panes = panes.select(F.window_time("_pane").alias("_pane_time"), *by, *names)
    merged = [c for name, a in aggregates.items() for c in a.merged(name)]
    windows = panes.groupBy(F.window("_pane_time", size, slide).alias("w"), *by).agg(*merged)
    return windows.select(*window_columns(), *by, *[a.result(name).alias(name) for name, a in aggregates.items()])
