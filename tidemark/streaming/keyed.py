"""A function per record with state and an event-time timer of its own for every key of a stream.

:func:`process_keyed` hands the rows of a key to a :class:`KeyedFunction` one by one, with the state it left
behind. Rows and timers of a key come in event-time order, however the stream is cut into micro-batches:
a timer that is due before a row fires before it. This needs an input whose later micro-batches hold later
rows, as the results of windows are (the watermark closes them in order); rows of one micro-batch may come
in any order. What a key holds in a micro-batch is sorted by one task, so put windows before it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

Step = tuple[list[tuple], Any, int | None]

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyedFunction:
    """What happens at a row and at a timer of one key.

    Both methods return the rows to emit, the state to keep (None: none) and when to call :meth:`timer`
    (epoch milliseconds, None: not). A new time replaces the one before.
    """

    output: str  # columns of the emitted rows
    state: str  # columns of the stored state

    def load(self, stored: tuple | None) -> Any:
        """Stored columns as the state the methods work on; once per key and micro-batch."""
        return stored

    def dump(self, state: Any) -> tuple:
        return state

    def row(self, key: tuple, row: Any, state: Any) -> Step:
        raise NotImplementedError

    def timer(self, key: tuple, at: int, state: Any) -> Step:
        raise NotImplementedError


class _Processor(StatefulProcessor):
    def __init__(self, function: KeyedFunction, columns: list[str], tms: str) -> None:
        self._function, self._columns, self._tms = function, columns, tms

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", self._function.state)
        self._timer = handle.getValueState("timer", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [frame for frame in rows]
        ordered = pd.concat(frames, ignore_index=True).sort_values(self._tms, kind="stable")
        stored = self._state.get() if self._state.exists() else None
        before = self._timer.get()[0] if self._timer.exists() else None
        state, due, out = self._function.load(stored), before, []
        for row in ordered.itertuples(index=False):
            while due is not None and due < getattr(row, self._tms):
                emitted, state, due = self._function.timer(key, due, state)
                out += emitted
            emitted, state, due = self._function.row(key, row, state)
            out += emitted
        out += self._settle(key, state, before, due, timerValues.getCurrentWatermarkInMs())
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        stored = self._state.get() if self._state.exists() else None
        self._timer.clear()
        out, state, due = self._function.timer(key, at, self._function.load(stored))
        out = out + self._settle(key, state, None, due, timerValues.getCurrentWatermarkInMs())
        yield from self._frames(out)

    def _settle(self, key, state, before: int | None, due: int | None, watermark: int) -> list[tuple]:
        """Fire what is due already, then store the state and the timer."""
        out = []
        while due is not None and due <= watermark:
            emitted, state, due = self._function.timer(key, due, state)
            out += emitted
        if state is None:
            self._state.clear()
        else:
            self._state.update(self._function.dump(state))
        if due != before:
            if before is not None:
                self._handle.deleteTimer(before)
            if due is None:
                self._timer.clear()
            else:
                self._timer.update((due,))
                self._handle.registerTimer(due)
        return out

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        # As objects: a column of whole numbers with NULLs would turn into floats.
        if out:
            yield pd.DataFrame(out, columns=self._columns, dtype=object)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind, and its timers, needs the RocksDB store; set it for the streams started from now on."""
    if spark.conf.get(STORE_CONF, None) != ROCKSDB:
        spark.conf.set(STORE_CONF, ROCKSDB)


@contextmanager
def _with_code(function: KeyedFunction) -> Iterator[None]:
    """Pickle a function with the code of its package while its plan is made.

    Spark also loads it in a process on the driver that does not see files added with ``addPyFile``.
    """
    own = {__name__.split(".")[0], type(function).__module__.split(".")[0]}
    known = cloudpickle.list_registry_pickle_by_value()
    modules = [m for name, m in list(sys.modules.items()) if name.split(".")[0] in own and name not in known]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        for module in modules:
            cloudpickle.unregister_pickle_by_value(module)


def process_keyed(
    stream: DataFrame, function: KeyedFunction, by: Sequence[str], tms: str = "tms"
) -> DataFrame:
    """Stream of what ``function`` emits for the rows of every key ``by``, in the order of ``tms``.

    ``tms`` are epoch milliseconds of an event time on which the stream has a watermark. Rows without a key
    or a time are dropped. Column names must not start with an underscore. The function travels
    with the plan, with what it uses of its own package; executors need not have it installed.
    """
    use_rocksdb(stream.sparkSession)
    for column in [*by, tms]:
        stream = stream.where(stream[column].isNotNull())
    columns = [c.split()[0] for c in function.output.split(", ")]
    processor = _Processor(function, columns, tms)
    with _with_code(function):
        return stream.groupBy(*by).transformWithStateInPandas(processor, function.output, "Append", "EventTime")
