"""Changes of a key's level on a stream, and its silences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.streaming.keyed import KeyedFunction, Step, process_keyed


class LevelChanges(KeyedFunction):
    """A row whenever the level differs from the one before (the first: from none), and one with the level
    NULL when nothing has come for ``silence_ms``. The level after a silence is always a change."""

    state = "level STRING"

    def __init__(self, keys: str, silence_ms: int) -> None:
        self.output = f"{keys}, at BIGINT, before STRING, level STRING"
        self._silence = silence_ms

    def row(self, key: tuple, row, state) -> Step:
        before = state[0] if state is not None else None
        changed = [(*key, row.tms, before, row.level)] if row.level != before else []
        return changed, (row.level,), row.tms + self._silence

    def timer(self, key: tuple, at: int, state) -> Step:
        return [(*key, at, state[0], None)], None, None


def level_changes(stream: DataFrame, silence_ms: int, by: Sequence[str]) -> DataFrame:
    """``by, at, before, level`` of a stream with ``by, tms, level`` that comes in the order of ``tms``.

    ``at`` is the time of the row with the new level, or when the silence was long enough; a row that comes
    exactly then ends the silence before it counts. Levels are not NULL.
    """
    fields = [stream.schema[c] for c in by]
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    slim = stream.select(*by, "tms", "level").where("level IS NOT NULL")
    return process_keyed(slim, LevelChanges(keys, silence_ms), by)
