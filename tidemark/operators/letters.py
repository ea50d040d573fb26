"""The letters table: one row per window with every assertion on that window as a column.

One aggregation per stream builds it, whatever the number of windows and assertions. Columns:
``by..., idx, w_start, last_idx, n_<side>..., <atom>...``; ``last_idx`` is where the word ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.atoms import Atom, count_rows
from tidemark.operators.windows import Discretizer
from tidemark.session import spread

SPINE_CHUNK = 4096


def sparse_letters(
    df: DataFrame, windows: Discretizer, atoms: Sequence[Atom], by: Sequence[str] = (), tms: str = "tms"
) -> DataFrame:
    """Assertions of every window that has rows, unordered: ``by, idx, atoms``.

    Overlapping windows are put together from panes: rows are aggregated once per pane, and only
    the small pane results are copied to each window.
    """
    tagged = windows.panes(df, tms)
    # Rows without a case or a time are in no letter. The join with the spine would add the same
    # conditions on its side only, and the two readers of this table could no longer share a shuffle.
    for column in [*by, "_pane"]:
        tagged = tagged.where(F.col(column).isNotNull())
    inside = F.col("_inside") if windows.gaps else None
    first = [atom.aggregate(inside) for atom in atoms]
    if not windows.overlapping:
        return tagged.groupBy(*by, F.col("_pane").alias("idx")).agg(*first)
    panes = tagged.groupBy(*by, "_pane").agg(*first)
    spread = panes.withColumn("idx", F.explode(windows.pane_windows(F.col("_pane"))))
    return spread.groupBy(*by, "idx").agg(*[atom.merge() for atom in atoms])


def _last_letter(sparse: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, last_idx``: index of the last window with rows.

    The values are counted too (a condition that always holds), so that this branch needs the same
    columns as the branch it is joined with and both read one shuffle; with the index alone column
    pruning would make it a second pass over the data.
    """
    rest = [c for c in sparse.columns if c not in by and c != "idx"]
    # The first value is the row count; counting it would not need it, as it is never NULL.
    seen = [(F.count(c) if i else F.max(c)).alias(f"_seen_{i}") for i, c in enumerate(rest)]
    ends = sparse.groupBy(*by).agg(F.max("idx").alias("last_idx"), *seen)
    for i in range(len(rest)):
        ends = ends.where(F.col(f"_seen_{i}") >= 0)
    return ends.select(*by, "last_idx")


def word_ends(df: DataFrame, windows: Discretizer, by: Sequence[str] = (), tms: str = "tms") -> DataFrame:
    """``by, last_idx`` of the word of one table: one aggregation, no letters are made."""
    return _last_letter(sparse_letters(df, windows, [count_rows("n_rows")], by, tms), by)


def spine(ends: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All indexes 0..last_idx of every case, generated in chunks so that one long word is produced
    by many tasks."""
    chunk = F.sequence(F.lit(0).cast("bigint"), F.expr(f"last_idx div {SPINE_CHUNK}"))
    low = F.col("_chunk") * F.lit(SPINE_CHUNK)
    indexes = F.sequence(low, F.least(F.col("last_idx"), low + F.lit(SPINE_CHUNK - 1)))
    chunks = ends.where(F.col("last_idx") >= 0).withColumn("_chunk", F.explode(chunk))
    return spread(chunks, *by, "_chunk").withColumn("idx", F.explode(indexes)).drop("_chunk")


def letters(
    windows: Discretizer,
    by: Sequence[str] = (),
    cap: int | None = None,
    tms: str = "tms",
    **sides: tuple[DataFrame, Sequence[Atom]],
) -> DataFrame:
    """Letters of one stream, or of several aligned ones: ``letters(w, src=(df, [atom, ...]))``.

    Empty windows in the middle are rows with the assertions' empty values. With several sides the
    word ends with the shorter one. ``cap``, if asked for, is the largest number of letters per case: the word
    then ends there.
    """
    by = list(by)
    parts: dict[str, tuple[DataFrame, list[Atom]]] = {}
    for side, (df, atoms) in sides.items():
        atoms = [count_rows(f"n_{side}"), *atoms]
        parts[side] = (sparse_letters(df, windows, atoms, by, tms), atoms)

    if len(parts) == 1:
        ((sparse, _),) = parts.values()
        ends = _last_letter(sparse, by)
    else:
        ends = None
        for sparse, _ in parts.values():
            last = _last_letter(sparse, by)
            ends = last if ends is None else ends.unionByName(last)
        ends = (
            ends.groupBy(*by)
            .agg(F.min("last_idx").alias("last_idx"), F.count("last_idx").alias("_sides"))
            .where(F.col("_sides") == len(parts))
            .drop("_sides")
        )
    if cap is not None:
        ends = ends.withColumn("last_idx", F.least("last_idx", F.lit(cap - 1).cast("bigint")))

    result = spine(ends, by)
    filled = [*by, "idx", windows.start_of(F.col("idx")).alias("w_start"), "last_idx"]
    for side, (sparse, atoms) in parts.items():
        result = result.join(sparse, [*by, "idx"], "left")
        # A window whose only rows lie in the gap after it is here with no rows: it is empty too.
        # Every value refers to the row count, so that it is read together with any of them and
        # this branch keeps the columns of _last_letter's.
        present = F.coalesce(F.col(f"n_{side}") > 0, F.lit(False))
        filled += [atom.or_empty(present) for atom in atoms]
    return result.select(*filled)
