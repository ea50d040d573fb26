"""Aggregates that can be put together from parts, for assertions and for windows.

An aggregate is a set of parts (each a built-in aggregate of the rows), how each part is merged, and
the value computed from the merged parts. Everything with this shape can be computed per pane first
and put together per window afterwards; it is also how a user's own aggregate is given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Merge = Callable[[Column], Column]


@dataclass(frozen=True)
class Mergeable:
    """``parts`` aggregate rows, ``merges`` put equal parts together, ``value`` is made of the merged parts."""

    parts: Sequence[Column]
    merges: Sequence[Merge]
    value: Callable[..., Column]

    def __post_init__(self) -> None:
        if len(self.parts) != len(self.merges):
            raise ValueError("every part needs a merge")

    def names(self, name: str) -> list[str]:
        return [f"_{name}_{i}" for i in range(len(self.parts))]

    def partial(self, name: str) -> list[Column]:
        return [part.alias(n) for part, n in zip(self.parts, self.names(name), strict=True)]

    def merged(self, name: str) -> list[Column]:
        return [merge(F.col(n)).alias(n) for merge, n in zip(self.merges, self.names(name), strict=True)]

    def result(self, name: str) -> Column:
        return self.value(*[F.col(n) for n in self.names(name)])


def _itself(x: Column) -> Column:
    return x


def maximum(value: Column) -> Mergeable:
    return Mergeable([F.max(value)], [F.max], _itself)


def minimum(value: Column) -> Mergeable:
    return Mergeable([F.min(value)], [F.min], _itself)


def total(value: Column) -> Mergeable:
    return Mergeable([F.sum(value)], [F.sum], _itself)


def mean(value: Column) -> Mergeable:
    """NULL without values."""
    return Mergeable([F.sum(value), F.count(value)], [F.sum, F.sum], lambda s, n: F.when(n > 0, s / n))


def counted(condition: Column | None = None) -> Mergeable:
    return Mergeable([F.count(F.lit(1)) if condition is None else F.count_if(condition)], [F.sum], _itself)


def approximate_distinct(value: Column) -> Mergeable:
    """Distinct values by a HyperLogLog sketch; sketches merge."""
    return Mergeable([F.hll_sketch_agg(value)], [F.hll_union_agg], F.hll_sketch_estimate)
