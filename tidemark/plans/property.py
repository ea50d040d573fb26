"""Checking one temporal property over many test cases in one Spark job.

All cases live in one table keyed by ``case_id``; the pipeline under test gets ``case_id`` as an
extra grouping key, letters and verdicts are computed for all cases at once, and the number of
Spark jobs depends neither on the number of cases nor on that of letters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.atoms import Atom
from tidemark.operators.letters import letters
from tidemark.operators.temporal import Formula, case_verdict, evaluate
from tidemark.operators.windows import Discretizer
from tidemark.session import scratch_path
from tidemark.sources.recordings import record_table
from tidemark.streaming.recorder import read_as_stream, record_stream

CASE = ("case_id",)

Subject = Callable[[DataFrame], DataFrame]
# (letters, input, output) -> letters with more columns, for assertions that relate two tables
Relate = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Property:
    """A formula, the windows it is read on and the assertions it is made of.

    ``input_atoms`` and ``output_atoms`` are aggregated per letter of the input and of the output
    stream; ``relate`` adds columns that need rows of both. ``max_letters`` ends every word after so
    many letters, if asked for: what comes later then has no say.
    """

    windows: Discretizer
    formula: Formula
    input_atoms: Sequence[Atom] = field(default_factory=tuple)
    output_atoms: Sequence[Atom] = field(default_factory=tuple)
    relate: Relate | None = None
    max_letters: int | None = None

    def evaluate(self, source: DataFrame, output: DataFrame, by: Sequence[str] = CASE) -> DataFrame:
        """The formula's value at every letter of every case. Both tables carry ``by..., tms``."""
        word = letters(
            self.windows,
            by,
            self.max_letters,
            input=(source, self.input_atoms),
            output=(output, self.output_atoms),
        )
        if self.relate is not None:
            word = self.relate(word, source, output)
        return evaluate(word, self.formula, by)


def for_all_cases(
    prop: Property,
    source: DataFrame,
    subject: Subject,
    cases: DataFrame,
    by: Sequence[str] = CASE,
    streaming: bool = False,
    record: bool = True,
) -> DataFrame:
    """One row per case: ``by..., verdict, passed``. ``source`` holds the rows of all cases
    (``by..., ts, tms`` and payload), ``subject`` is the pipeline under test.

    The input is recorded first: it is read by the pipeline and by the assertions, and generated
    rows would be computed for each of them. Give ``record=False`` when the input is a stored table.
    With ``streaming`` the pipeline runs as a stream over the recorded input and its output is
    recorded too.
    """
    if streaming:
        path = scratch_path(source.sparkSession, "case-input")
        source = record_table(source, path)
        output = record_stream(read_as_stream(source, path), subject, "case-output")
    else:
        if record:
            source = record_table(source, scratch_path(source.sparkSession, "case-input"))
        output = subject(source)
    output = output.withColumn("tms", F.unix_millis("ts"))
    _refuse_empty_start(prop, source)
    return case_verdict(prop.evaluate(source, output, by), cases, by)


def _refuse_empty_start(prop: Property, source: DataFrame) -> None:
    """Fail when no case has a row in the letters that the verdict looks at.

    A verdict is the formula's value at letter 0. If the windows start long before the first row of
    all, every letter it looks at is empty and the answer says nothing about the data.
    """
    looked_at = prop.formula.lookahead() + 1
    first = prop.windows.panes(source.select("tms")).agg(F.min(prop.windows.first_window(F.col("_pane")))).first()[0]
    if first is not None and first >= looked_at:
        raise ValueError(
            f"the first row of all cases is in letter {first}, the formula looks at {looked_at} letters from letter 0; "
            "set start_ms of the windows to where the data begins"
        )
