"""Temporal formulas one letter after the other: a small machine per case.

A formula becomes a tree of nodes. Each node takes the values of its parts in letter order and gives its
own values in letter order, each as soon as it and all earlier ones are decided. Equal values that follow
each other are one run ``(value, count)``, so a long silence is one step.

What makes the state small: the positions an ``until`` has not decided yet are always the latest ones,
and which of them an unclear value touched is told by one index. So ``until``, ``always`` and
``eventually`` keep four numbers, whatever the horizon. ``and`` / ``or`` / ``implies`` keep, as runs, the values
of a part that is ahead of another one, which is by no more letters than the formula looks ahead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.kleene import FALSE, TRUE, UNDECIDED, decide
from tidemark.operators import temporal

Runs = list[tuple[int, int]]
# A formula as plain nested tuples: ("leaf", i), ("true",), ("not", p), ("next", p), ("least" | "greatest", p, ...),
# ("until", hold, release, horizon).
Plan = tuple


def _add(runs: Runs, value: int, count: int) -> None:
    if count <= 0:
        return
    if runs and runs[-1][0] == value:
        runs[-1] = (value, runs[-1][1] + count)
    else:
        runs.append((value, count))


def _drop(runs: Runs, count: int) -> tuple[Runs, int]:
    """The runs without their first ``count`` values, and how many of these were not there."""
    for i, (value, n) in enumerate(runs):
        if count < n:
            return [(value, n - count), *runs[i + 1 :]], 0
        count -= n
    return [], count


class _Node:
    def __init__(self, *parts: _Node) -> None:
        self.parts = parts

    def feed(self, letter: tuple[int, ...], count: int) -> Runs:
        """Values decided by ``count`` more letters with these leaf values."""
        return self.take([part.feed(letter, count) for part in self.parts])

    def finish(self) -> Runs:
        """All values that are left when the word ends: letters past its end are Undecided."""
        out = self.take([part.finish() for part in self.parts])
        for value, count in self.rest():
            _add(out, value, count)
        return out

    def take(self, inputs: list[Runs]) -> Runs:
        raise NotImplementedError

    def rest(self) -> Runs:
        return []

    own: list = []

    def dump(self) -> list:
        return [self.own, *[part.dump() for part in self.parts]]

    def load(self, stored: list) -> None:
        self.own = stored[0]
        for part, kept in zip(self.parts, stored[1:]):
            part.load(kept)


class _Leaf(_Node):
    def __init__(self, index: int) -> None:
        super().__init__()
        self._index = index

    def feed(self, letter: tuple[int, ...], count: int) -> Runs:
        return [(letter[self._index], count)]

    def finish(self) -> Runs:
        return []


class _Not(_Node):
    def take(self, inputs: list[Runs]) -> Runs:
        return [(-value, count) for value, count in inputs[0]]


class _Next(_Node):
    def __init__(self, part: _Node) -> None:
        super().__init__(part)
        self.own = [0]  # is the first value dropped?

    def take(self, inputs: list[Runs]) -> Runs:
        runs = inputs[0]
        if runs and not self.own[0]:
            self.own = [1]
            runs, _ = _drop(runs, 1)
        return runs

    def rest(self) -> Runs:
        return [(UNDECIDED, self.own[0])]


class _Aligned(_Node):
    """Parts that decide at different times, brought together position by position."""

    def __init__(self, *parts: _Node) -> None:
        super().__init__(*parts)
        # Per part: values from the next position on, and how many values still to come are not needed.
        self.own = [[[], 0] for _ in parts]

    def arrive(self, inputs: list[Runs]) -> None:
        kept = []
        for (waiting, owed), runs in zip(self.own, inputs):
            runs, owed = _drop(runs, owed)
            waiting = [tuple(run) for run in waiting]
            for value, count in runs:
                _add(waiting, value, count)
            kept.append([waiting, owed])
        self.own = kept

    def advance(self, count: int) -> None:
        moved = []
        for waiting, owed in self.own:
            waiting, missing = _drop(waiting, count)
            moved.append([waiting, owed + missing])
        self.own = moved


class _Extreme(_Aligned):
    """Least or greatest of its parts; one part alone may decide."""

    def __init__(self, choose, decisive: int, *parts: _Node) -> None:
        super().__init__(*parts)
        self._choose, self._decisive = choose, decisive

    def take(self, inputs: list[Runs]) -> Runs:
        self.arrive(inputs)
        out: Runs = []
        while True:
            heads = [waiting[0] if waiting else None for waiting, _ in self.own]
            alone = [head[1] for head in heads if head and head[0] == self._decisive]
            if alone:
                value, count = self._decisive, max(alone)
            elif all(heads):
                value, count = self._choose(v for v, _ in heads), min(n for _, n in heads)
            else:
                return out
            _add(out, value, count)
            self.advance(count)


class _Until(_Aligned):
    """``hold`` at every letter before one at which ``release`` is true, within the horizon."""

    def __init__(self, horizon: int, hold: _Node, release: _Node) -> None:
        super().__init__(hold, release)
        self._horizon = horizon
        # First position not decided; last letter; last letter at which hold was unclear; last letter at which
        # release was not false.
        self._seen = [0, -1, -1, -1]

    def dump(self) -> list:
        return [[self._seen, self.own], *[part.dump() for part in self.parts]]

    def load(self, stored: list) -> None:
        super().load([stored[0][1], *stored[1:]])
        self._seen = list(stored[0][0])

    def take(self, inputs: list[Runs]) -> Runs:
        self.arrive(inputs)
        out: Runs = []
        while all(waiting for waiting, _ in self.own):
            (hold, n), (release, m) = (waiting[0] for waiting, _ in self.own)
            count = min(n, m)
            self._step(hold, release, 1, out)
            if count > 1:
                if release == TRUE or hold == FALSE or hold == release == UNDECIDED:
                    # Each of these letters decides its own position, and nothing before it is open.
                    _add(out, release, count - 1)
                    end = self._seen[1] + count - 1
                    self._seen = [end + 1, end, end, end]
                else:
                    self._step(hold, release, count - 1, out)
            self.advance(count)
        return out

    def _step(self, hold: int, release: int, count: int, out: Runs) -> None:
        first, last, unclear, maybe = self._seen
        last += count

        def decide(upto: int, value) -> None:
            """Positions up to ``upto``, those with ``value(boundary)`` told apart by one index."""
            nonlocal first
            upto = min(upto, last)
            boundary, before, after = value
            cut = min(upto, boundary) + 1
            if cut > first:
                _add(out, before, cut - first)
                first = cut
            if upto + 1 > first:
                _add(out, after, upto + 1 - first)
                first = upto + 1

        if release == TRUE:
            decide(last, (unclear, UNDECIDED, TRUE))
        if release >= UNDECIDED:
            maybe = last
        if hold == FALSE:
            decide(last, (maybe, UNDECIDED, FALSE))
        elif hold == UNDECIDED:
            unclear = last
        # After an unclear hold no better than Undecided can come, so those that may be released are decided.
        decide(min(unclear, maybe), (maybe, UNDECIDED, FALSE))
        decide(last - self._horizon + 1, (maybe, UNDECIDED, FALSE))
        self._seen = [first, last, unclear, maybe]

    def rest(self) -> Runs:
        first, last, _, _ = self._seen
        self._seen = [last + 1, *self._seen[1:]]
        return [(UNDECIDED, last + 1 - first)]


class _True(_Node):
    def feed(self, letter: tuple[int, ...], count: int) -> Runs:
        return [(TRUE, count)]

    def finish(self) -> Runs:
        return []


def _build(plan: Plan) -> _Node:
    kind, *rest = plan
    if kind == "leaf":
        return _Leaf(rest[0])
    if kind == "true":
        return _True()
    if kind == "not":
        return _Not(_build(rest[0]))
    if kind == "next":
        return _Next(_build(rest[0]))
    if kind == "until":
        hold, release, horizon = rest
        return _Until(horizon, _build(hold), _build(release))
    parts = [_build(part) for part in rest]
    return _Extreme(min, FALSE, *parts) if kind == "least" else _Extreme(max, TRUE, *parts)


@dataclass
class Progress:
    """The machine of one case."""

    plan: Plan

    def __post_init__(self) -> None:
        self._root = _build(self.plan)

    def feed(self, letter: tuple[int, ...], count: int = 1) -> Runs:
        return self._root.feed(letter, count) if count > 0 else []

    def finish(self) -> Runs:
        return self._root.finish()

    def dump(self) -> list:
        """The state as nested lists of numbers."""
        return self._root.dump()

    def load(self, stored: list) -> Progress:
        self._root.load(stored)
        return self


def plan_of(formula: temporal.Formula) -> tuple[Plan, list[Column]]:
    """A formula as a plan, and the three-valued columns of a letter that are its leaves."""
    leaves: list[Column] = []

    def leaf(value: Column) -> Plan:
        leaves.append(value)
        return ("leaf", len(leaves) - 1)

    def plan(f: temporal.Formula) -> Plan:
        match f:
            case temporal.Now(condition):
                return leaf(decide(condition))
            case temporal.Coded(name):
                return leaf(F.col(name))
            case temporal.Next(body):
                return ("next", plan(body))
            case temporal.Always(body, horizon):
                return ("not", ("until", ("true",), ("not", plan(body)), horizon))
            case temporal.Eventually(body, horizon):
                return ("until", ("true",), plan(body), horizon)
            case temporal.Until(hold, release, horizon):
                return ("until", plan(hold), plan(release), horizon)
            case temporal.All(parts):
                return ("least", *map(plan, parts))
            case temporal.Any(parts):
                return ("greatest", *map(plan, parts))
            case temporal.Implies(premise, conclusion):
                return ("greatest", ("not", plan(premise)), plan(conclusion))
        raise ValueError(f"{type(f).__name__} is not told letter by letter")

    return plan(formula), leaves
