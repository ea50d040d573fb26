"""Assertions on the rows of one letter, each one mergeable aggregate column.

Ten assertions on a stream are ten columns of one ``groupBy``. Every aggregate can be merged
from partial results, so Spark combines map-side and a hot key costs no more than a cold one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


Aggregate = Callable[[Column], Column]


@dataclass(frozen=True)
class Atom:
    """An aggregate of the rows of a letter, called ``name`` in the result.

    ``aggregate_rows`` is any built-in aggregate of ``value``, ``merge_parts`` puts results of parts of a
    letter together, ``empty`` is what a letter without rows has. For a value that needs more than one part
    (a mean, say) use one atom per part and compute it from the letters.
    """

    name: str
    value: Column
    aggregate_rows: Aggregate
    merge_parts: Aggregate
    empty: Any = None
    condition: bool = False  # a NULL value does not hold

    def aggregate(self, inside: Column | None = None) -> Column:
        value = F.coalesce(self.value, F.lit(False)) if self.condition else self.value
        if inside is not None:
            value = F.when(inside, value)
        return self.aggregate_rows(value).alias(self.name)

    def merge(self) -> Column:
        return self.merge_parts(F.col(self.name)).alias(self.name)

    def or_empty(self, present: Column) -> Column:
        """The assertion's value, or what it is at a letter without rows (``present`` false)."""
        return F.when(present, F.col(self.name)).otherwise(F.lit(self.empty)).alias(self.name)


def aggregate(name: str, value: Column, rows: Aggregate, merge: Aggregate | None = None, empty: Any = None) -> Atom:
    """A user's own aggregate, e.g. ``aggregate("last", F.col("tms"), F.max)``; parts are merged by the same
    function unless another is given. Rows of a letter's gap come as NULL, which built-in aggregates skip."""
    return Atom(name, value, rows, merge or rows, empty)


def mean_of(name: str, value: Column) -> list[Atom]:
    """Sum and count of a value, from which :func:`mean_value` takes the mean of every letter."""
    return [aggregate(f"{name}_sum", value, F.sum), aggregate(f"{name}_count", value, F.count, F.sum, 0)]


def mean_value(name: str) -> Column:
    """Mean of a letter's values; NULL without values."""
    return F.when(F.col(f"{name}_count") > 0, F.col(f"{name}_sum") / F.col(f"{name}_count"))


def foreach_element(name: str, predicate: Column) -> Atom:
    """Every row satisfies the predicate; true on no rows."""
    return Atom(name, predicate, F.bool_and, F.bool_and, True, condition=True)


def foreach_projection(name: str, projection: Column, predicate: Callable[[Column], Column]) -> Atom:
    """Every row's projected value satisfies the predicate."""
    return foreach_element(name, predicate(projection))


def foreach_context(name: str, context: Any, predicate: Callable[[Any], Column]) -> Atom:
    """Every row satisfies a predicate built from a captured value.

    When the context is a table, mark the rows with :func:`tidemark.operators.sets.contained`
    first and use the mark as the predicate.
    """
    return foreach_element(name, predicate(context))


def exists_element(name: str, predicate: Column) -> Atom:
    """Some row satisfies the predicate; false on no rows."""
    return Atom(name, predicate, F.bool_or, F.bool_or, False, condition=True)


def exists_projection(name: str, projection: Column, predicate: Callable[[Column], Column]) -> Atom:
    """Some row's projected value satisfies the predicate."""
    return exists_element(name, predicate(projection))


def exists_context(name: str, context: Any, predicate: Callable[[Any], Column]) -> Atom:
    """Some row satisfies a predicate built from a captured value."""
    return exists_element(name, predicate(context))


def be_empty(name: str) -> Atom:
    """No rows."""
    return foreach_element(name, F.lit(False))


def be_non_empty(name: str) -> Atom:
    """Some row."""
    return exists_element(name, F.lit(True))


def count_rows(name: str, predicate: Column | None = None) -> Atom:
    """Number of rows (that satisfy a predicate)."""
    return Atom(name, F.lit(True) if predicate is None else predicate, F.count_if, F.sum, 0, condition=True)
