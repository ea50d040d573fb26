"""Bounded temporal formulas over a letters table, three-valued.

``evaluate`` gives the formula's value at every letter at once. A horizon counts letters including
the current one; a letter past the end of the word is Undecided.

All operators are built from one kind of column, "index of the next letter at which c holds":
a running minimum over the letters in descending order. It costs the same for any horizon, and a
sliding frame of n rows is never needed. The letters of a case are worked on in blocks of
``BLOCK`` consecutive ones; each block also gets the first letters of the following block that its
formulas look at, so a single endless word is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.kleene import FALSE, TRUE, UNDECIDED, code, conj, decide, disj, implies, verdict_name

BLOCK = 4096


class _Letters:
    """The table a formula is compiled against; sub-formula values become columns of it."""

    def __init__(self, df: DataFrame, by: Sequence[str]) -> None:
        self.df = df
        self._descending = W.partitionBy(*by, "_block").orderBy(F.col("idx").desc())

    def keep(self, *values: Column) -> list[Column]:
        """Materialise values side by side, so that all window columns share one Window node."""
        first = len(self.df.columns)
        names = [f"_v{first + i}" for i in range(len(values))]
        self.df = self.df.withColumns(dict(zip(names, values)))
        return [F.col(name) for name in names]

    def following(self, value: Column) -> Column:
        """The value one letter later."""
        return F.lag(value, 1).over(self._descending)

    def next_indexes(self, *conditions: Column) -> list[Column]:
        """For each condition, the index of the first letter from here on at which it holds."""
        ahead = self._descending.rowsBetween(W.unboundedPreceding, W.currentRow)
        return self.keep(*[F.min(F.when(c, F.col("idx"))).over(ahead) for c in conditions])

    @staticmethod
    def within(index: Column, horizon: int) -> Column:
        return F.coalesce(index < F.col("idx") + F.lit(horizon), F.lit(False))

    @staticmethod
    def complete(horizon: int) -> Column:
        return F.col("last_idx") >= F.col("idx") + F.lit(horizon - 1)


class Formula:
    """A temporal formula; combine with ``&``, ``|``, ``>>`` (implies)."""

    def lookahead(self) -> int:
        raise NotImplementedError

    def compile(self, letters: _Letters) -> Column:
        raise NotImplementedError

    def __and__(self, other: Formula) -> Formula:
        return All((self, other))

    def __or__(self, other: Formula) -> Formula:
        return Any((self, other))

    def __rshift__(self, other: Formula) -> Formula:
        return Implies(self, other)


@dataclass(frozen=True)
class Now(Formula):
    """A boolean condition on the current letter's columns (``now``, ``nowTime``, ``consume``)."""

    condition: Column

    def lookahead(self) -> int:
        return 0

    def compile(self, letters: _Letters) -> Column:
        return decide(self.condition)


@dataclass(frozen=True)
class Coded(Formula):
    """A column that already holds three-valued codes, such as a bound assertion."""

    name: str

    def lookahead(self) -> int:
        return 0

    def compile(self, letters: _Letters) -> Column:
        return F.col(self.name)


@dataclass(frozen=True)
class Next(Formula):
    body: Formula

    def lookahead(self) -> int:
        return 1 + self.body.lookahead()

    def compile(self, letters: _Letters) -> Column:
        (value,) = letters.keep(self.body.compile(letters))
        (result,) = letters.keep(F.coalesce(letters.following(value), code(UNDECIDED)))
        return result


@dataclass(frozen=True)
class BindNext(Formula):
    """A condition on this letter and the following one: ``condition(this, following)``, where both
    arguments map a column name to a Column."""

    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]

    def lookahead(self) -> int:
        return 1

    def compile(self, letters: _Letters) -> Column:
        has_next = F.col("last_idx") > F.col("idx")
        (holds,) = letters.keep(self.condition(F.col, lambda name: letters.following(F.col(name))))
        return F.when(has_next, decide(holds)).otherwise(code(UNDECIDED))


@dataclass(frozen=True)
class Always(Formula):
    body: Formula
    horizon: int

    def lookahead(self) -> int:
        return self.horizon - 1 + self.body.lookahead()

    def compile(self, letters: _Letters) -> Column:
        if self.horizon == 1:
            return self.body.compile(letters)
        (value,) = letters.keep(self.body.compile(letters))
        false_at, open_at = letters.next_indexes(value == FALSE, value != TRUE)
        return (
            F.when(letters.within(false_at, self.horizon), code(FALSE))
            .when(letters.within(open_at, self.horizon) | ~letters.complete(self.horizon), code(UNDECIDED))
            .otherwise(code(TRUE))
        )


@dataclass(frozen=True)
class Eventually(Formula):
    body: Formula
    horizon: int

    def lookahead(self) -> int:
        return self.horizon - 1 + self.body.lookahead()

    def compile(self, letters: _Letters) -> Column:
        if self.horizon == 1:
            return self.body.compile(letters)
        (value,) = letters.keep(self.body.compile(letters))
        true_at, open_at = letters.next_indexes(value == TRUE, value != FALSE)
        return (
            F.when(letters.within(true_at, self.horizon), code(TRUE))
            .when(letters.within(open_at, self.horizon) | ~letters.complete(self.horizon), code(UNDECIDED))
            .otherwise(code(FALSE))
        )


@dataclass(frozen=True)
class Until(Formula):
    """``hold`` at every letter before one at which ``release`` is true, within the horizon."""

    hold: Formula
    release: Formula
    horizon: int

    def lookahead(self) -> int:
        return self.horizon - 1 + max(self.hold.lookahead(), self.release.lookahead())

    def compile(self, letters: _Letters) -> Column:
        if self.horizon == 1:
            return self.release.compile(letters)
        hold, release = letters.keep(self.hold.compile(letters), self.release.compile(letters))
        released, maybe_released, broken, maybe_broken = letters.next_indexes(
            release == TRUE, release >= UNDECIDED, hold == FALSE, hold <= UNDECIDED
        )

        def reached(release_at: Column, broken_at: Column) -> Column:
            return letters.within(release_at, self.horizon) & F.coalesce(broken_at >= release_at, F.lit(True))

        still_open = ~letters.within(broken, self.horizon) & ~letters.complete(self.horizon)
        return (
            F.when(reached(released, maybe_broken), code(TRUE))
            .when(reached(maybe_released, broken) | still_open, code(UNDECIDED))
            .otherwise(code(FALSE))
        )


@dataclass(frozen=True)
class All(Formula):
    parts: tuple[Formula, ...]

    def lookahead(self) -> int:
        return max(p.lookahead() for p in self.parts)

    def compile(self, letters: _Letters) -> Column:
        return conj(*[p.compile(letters) for p in self.parts])


@dataclass(frozen=True)
class Any(Formula):
    parts: tuple[Formula, ...]

    def lookahead(self) -> int:
        return max(p.lookahead() for p in self.parts)

    def compile(self, letters: _Letters) -> Column:
        return disj(*[p.compile(letters) for p in self.parts])


@dataclass(frozen=True)
class Implies(Formula):
    premise: Formula
    conclusion: Formula

    def lookahead(self) -> int:
        return max(self.premise.lookahead(), self.conclusion.lookahead())

    def compile(self, letters: _Letters) -> Column:
        return implies(self.premise.compile(letters), self.conclusion.compile(letters))


def now(condition: Column | str) -> Formula:
    return Now(F.col(condition) if isinstance(condition, str) else condition)


def coded(name: str) -> Formula:
    return Coded(name)


def next_(body: Formula) -> Formula:
    return Next(body)


def bind_next(condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> Formula:
    return BindNext(condition)


def always(body: Formula, during: int) -> Formula:
    return Always(body, during)


def eventually(body: Formula, on: int) -> Formula:
    return Eventually(body, on)


def until(hold: Formula, release: Formula, on: int) -> Formula:
    return Until(hold, release, on)


def all_of(*parts: Formula) -> Formula:
    return All(tuple(parts))


def any_of(*parts: Formula) -> Formula:
    return Any(tuple(parts))


def evaluate(
    letters: DataFrame, formula: Formula, by: Sequence[str] = (), name: str = "value", block: int = BLOCK
) -> DataFrame:
    """The letters table with the formula's value at each letter (TINYINT code) as ``name``."""
    columns = letters.columns
    ahead = formula.lookahead()
    if ahead == 0:
        return letters.withColumn(name, formula.compile(_Letters(letters, by)))
    block = max(block, ahead)
    number = F.expr(f"idx div {block}")
    owned = F.array(number)
    shared = (F.col("idx") % F.lit(block) < F.lit(ahead)) & (number > 0)
    copies = letters.withColumn("_block", F.explode(F.when(shared, F.array(number, number - 1)).otherwise(owned)))
    work = _Letters(copies, by)
    (value,) = work.keep(formula.compile(work))
    return work.df.where(F.col("_block") == number).select(*columns, value.alias(name))


def with_verdict(df: DataFrame, value: str = "value", name: str = "verdict") -> DataFrame:
    """Replace the code column by True / False / Undecided."""
    return df.withColumn(name, verdict_name(F.col(value))).drop(*([value] if value != name else []))


def case_verdict(evaluated: DataFrame, cases: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """One row per case: the value at letter 0 and whether the case passes.

    A case without letters is Undecided; Undecided passes.
    """
    first = evaluated.where(F.col("idx") == 0).select(*by, value)
    joined = cases.select(*by).distinct().join(first, list(by), "left")
    result = F.coalesce(F.col(value), code(UNDECIDED))
    return joined.select(*by, verdict_name(result).alias("verdict"), (result >= UNDECIDED).alias("passed"))
