"""Verdicts while the stream runs.

The letters of the stream are one windowed aggregation; ``always`` and ``eventually`` over n
letters are a second one over a sliding window of n letters on its result. Both run in append
mode: a verdict is emitted once, when the watermark closes its last letter.

Only letters with rows pass through the stream. For ``always(foreach)`` and ``eventually(exists)``
an empty letter is neutral, so what is emitted is final; positions all of whose letters are empty
emit nothing and are added by :func:`complete_verdicts` from where the word ends.

:func:`monitor_formula` takes any other formula: the letters go through a machine per case
(:mod:`tidemark.operators.progress`) whose state is a few numbers, whatever the horizon.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kleene import FALSE, TRUE, UNDECIDED, code
from tidemark.operators.atoms import Atom, count_rows
from tidemark.operators.letters import spine
from tidemark.operators.progress import Plan, Progress, Runs, plan_of
from tidemark.operators.temporal import Formula
from tidemark.operators.windows import Windows
from tidemark.streaming.keyed import KeyedFunction, Step, process_keyed
from tidemark.streaming.recorder import END_OF_INPUT_MS


def _letter_window(windows: Windows) -> Column:
    if windows.slide_ms is not None:
        raise ValueError("the streaming monitor takes tumbling windows")
    if not windows.strict:
        # Rows before the start would have to join letter 0; a stream's windows cannot take them in.
        raise ValueError("the streaming monitor takes strict windows: rows before start_ms are in no letter")
    size = windows.size_ms
    return F.window("ts", f"{size} milliseconds", startTime=f"{windows.start_ms % size} milliseconds").alias("w")


def _frames(
    stream: DataFrame, inner: Column, merge, windows: Windows, horizon: int, by: Sequence[str], name: str
) -> DataFrame:
    size = windows.size_ms
    start = f"{windows.start_ms % size} milliseconds"
    letters = stream.groupBy(*by, _letter_window(windows)).agg(inner.alias("_holds"))
    frame = F.window(
        F.window_time("w"),
        f"{size * horizon} milliseconds",
        f"{size} milliseconds",
        startTime=start,
    ).alias("w")
    inside = letters.where(F.unix_millis(F.col("w.start")) >= F.lit(windows.start_ms))
    frames = inside.groupBy(*by, frame).agg(merge("_holds").alias(name))
    first = F.unix_millis(F.col("w.start")) - F.lit(windows.start_ms)
    idx = F.floor(first / F.lit(size)).cast("bigint")
    placed = frames.select(*by, idx.alias("idx"), F.unix_millis(F.col("w.end")).alias("frame_end"), name)
    return placed.where("idx >= 0")


def monitor_always(
    stream: DataFrame, predicate: Column, windows: Windows, horizon: int, by: Sequence[str] = (), name: str = "holds"
) -> DataFrame:
    """Stream of ``by, idx, frame_end, holds``: does every row of letters idx..idx+horizon-1 satisfy
    the predicate?"""
    inner = F.bool_and(F.coalesce(predicate, F.lit(False)))
    return _frames(stream, inner, F.bool_and, windows, horizon, by, name)


def monitor_eventually(
    stream: DataFrame, predicate: Column, windows: Windows, horizon: int, by: Sequence[str] = (), name: str = "holds"
) -> DataFrame:
    """As :func:`monitor_always`: does some row of those letters satisfy the predicate?"""
    inner = F.bool_or(F.coalesce(predicate, F.lit(False)))
    return _frames(stream, inner, F.bool_or, windows, horizon, by, name)


def complete_verdicts(
    frames: DataFrame, ends: DataFrame, horizon: int, empty: bool, by: Sequence[str] = (), name: str = "holds"
) -> DataFrame:
    """Recorded frames as three-valued verdicts for positions 0..last_idx of each case.

    ``ends`` is ``by, last_idx``; ``empty`` is the value of a frame without rows (true for
    ``always``, false for ``eventually``). A frame that reaches past the last letter decides only
    in the direction that further letters cannot change.
    """
    keys = [*by, "idx"]
    joined = spine(ends, by).join(frames.select(*keys, name), keys, "left")
    holds = F.coalesce(F.col(name), F.lit(empty))
    short = F.col("idx") + F.lit(horizon - 1) > F.col("last_idx")
    settled = code(TRUE) if not empty else code(FALSE)
    value = (
        F.when(holds == F.lit(not empty), settled)
        .when(short, code(UNDECIDED))
        .otherwise(code(TRUE if empty else FALSE))
    )
    return joined.select(*keys, value.alias("value"))


class _Verdicts(KeyedFunction):
    state = "machine STRING"

    def __init__(self, plan: Plan, empty: tuple[int, ...], keys: str) -> None:
        self.output = f"{keys}, first BIGINT, last BIGINT, value TINYINT"
        self._plan, self._empty = plan, empty

    def load(self, stored: tuple | None) -> list:
        """Letters seen, positions decided, machine."""
        if stored is None:
            return [0, 0, Progress(self._plan)]
        letters, decided, machine = json.loads(stored[0])
        return [letters, decided, Progress(self._plan).load(machine)]

    def dump(self, state: list) -> tuple:
        letters, decided, machine = state
        return (json.dumps([letters, decided, machine.dump()]),)

    def row(self, key: tuple, row, state: list) -> Step:
        state = state or self.load(None)
        letters, _, machine = state
        codes = tuple(int(getattr(row, f"leaf{i}")) for i in range(len(self._empty)))
        out = self._rows(key, state, machine.feed(self._empty, int(row.idx) - letters))
        out += self._rows(key, state, machine.feed(codes))
        state[0] = int(row.idx) + 1
        return out, state, END_OF_INPUT_MS

    def timer(self, key: tuple, at: int, state: list) -> Step:
        return self._rows(key, state, state[2].finish()), None, None

    @staticmethod
    def _rows(key: tuple, state: list, runs: Runs) -> list[tuple]:
        out = []
        for value, count in runs:
            if count:
                out.append((*key, state[1], state[1] + count - 1, value))
                state[1] += count
        return out


def monitor_formula(
    stream: DataFrame,
    formula: Formula,
    windows: Windows,
    atoms: Sequence[Atom],
    by: Sequence[str] = (),
    name: str = "value",
    side: str = "rows",
) -> DataFrame:
    """Stream of ``by, idx, value``: the formula's three-valued value at every letter of every case.

    The same rows as ``evaluate(letters(windows, by, side=(rows, atoms)), formula, by)``. A value is emitted once, when
    it and the values at all earlier letters are decided; what is still open when a bounded input ends
    (:func:`tidemark.streaming.recorder.record_stream`) comes with its end. Letters without rows are seen when
    the next one with rows closes, as the word may have ended before. Conditions may refer to the atoms and to
    ``n_<side>``; ``bind_next`` is refused, as are windows that are not strict and tumbling.
    """
    plan, leaves = plan_of(formula)
    by = list(by)
    atoms = [count_rows(f"n_{side}"), *atoms]
    present = stream
    for column in by:
        present = present.where(F.col(column).isNotNull())
    letters = present.groupBy(*by, _letter_window(windows)).agg(*[atom.aggregate() for atom in atoms])
    codes = [leaf.cast("tinyint").alias(f"leaf{i}") for i, leaf in enumerate(leaves)]

    # What the leaves are at a letter without rows: one row, computed once.
    types = {f.name: f.dataType for f in letters.schema.fields}
    blank = [F.lit(atom.empty).cast(types[atom.name]).alias(atom.name) for atom in atoms]
    empty = tuple(stream.sparkSession.range(1).select(*blank).select(*codes).first())

    offset = F.unix_millis("w.start") - F.lit(windows.start_ms)
    placed = letters.select(
        *by,
        (F.unix_millis("w.end") - 1).alias("tms"),
        F.floor(offset / F.lit(windows.size_ms)).cast("bigint").alias("idx"),
        *codes,
    ).where("idx >= 0")
    keys = by
    if not by:  # one case
        keys, placed = ["only"], placed.withColumn("only", F.lit(0))
    fields = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in keys)
    runs = process_keyed(placed, _Verdicts(plan, empty, fields), keys)
    return runs.select(*by, F.explode(F.sequence("first", "last")).alias("idx"), F.col("value").alias(name))
