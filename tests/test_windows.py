"""Cutting into windows, against the definition and against brute force."""

from __future__ import annotations

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.operators.atoms import exists_element, foreach_element
from tidemark.operators.letters import letters
from tidemark.operators.windows import Discretizer, Windows


def timed(spark, times):
    return spark.createDataFrame([(t,) for t in times], "tms BIGINT")


def brute_force(times, w: Windows):
    """Start and contents of every window, straight from the definition."""
    if not times:
        return []
    out, last = [], max(times)
    if w.slide_ms is None:

        def index(t):
            return int((t - w.start_ms) / w.size_ms)  # toward zero

        for i in range(index(last) + 1):
            out.append((w.start_ms + i * w.size_ms, sorted(t for t in times if index(t) == i)))
        return out
    start = w.start_ms
    while start <= last:
        out.append((start, sorted(t for t in times if start <= t < start + w.size_ms)))
        start += w.slide_ms
    return out


def cut(spark, times, w: Windows):
    word = letters(w, rows=(timed(spark, times), []))
    inside = {}
    for r in w.assign(timed(spark, times)).collect():
        inside.setdefault(r["w_start"], []).append(r["tms"])
    result = []
    for r in word.orderBy("idx").collect():
        content = sorted(inside.get(r["w_start"], []))
        assert r["n_rows"] == len(content)
        assert r["w_start"] == w.start_ms + r["idx"] * w.step_ms
        result.append((r["w_start"], content))
    return result


CASES = [
    ([], Windows(100)),
    ([0, 99, 100, 350], Windows(100)),
    ([150], Windows(100, start_ms=200)),
    ([50], Windows(100, start_ms=200)),
    ([50, 150, 250, 431], Windows(100, start_ms=200)),
    ([0, 60, 120], Windows(100, 50)),
    ([0, 60, 120], Windows(50, 100)),
    ([0, 60, 170], Windows(50, 100)),
    ([10], Windows(100, 50, start_ms=20)),
    ([20, 70, 119, 120, 400], Windows(100, 50, start_ms=20)),
    ([0, 7, 30, 31, 99], Windows(12, 5)),
    ([99, 100, 101], Windows(100, 100)),
]


@pytest.mark.parametrize("times,w", CASES)
def test_against_definition(spark, times, w):
    assert cut(spark, times, w) == brute_force(times, w)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    times=st.lists(st.integers(0, 400), max_size=25),
    size=st.integers(1, 90),
    slide=st.one_of(st.none(), st.integers(1, 120)),
    start=st.integers(0, 150),
)
def test_against_brute_force(spark, times, size, slide, start):
    w = Windows(size, slide, start)
    assert cut(spark, times, w) == brute_force(times, w)


def test_strict_drops_rows_before_the_first_window(spark):
    assert cut(spark, [150, 210], Windows(100, start_ms=200, strict=True)) == [(200, [210])]


def test_rejects_bad_sizes():
    with pytest.raises(ValueError):
        Windows(0)
    with pytest.raises(ValueError):
        Windows(10, -1)


def test_boundaries(spark):
    assert rows(Windows(100).assign(timed(spark, [0, 99, 100])), "tms", "idx") == [(0, 0), (99, 0), (100, 1)]


def test_empty_letters_take_empty_values(spark):
    df = spark.createDataFrame([(0, 5), (250, -1)], "tms BIGINT, v INT")
    word = letters(
        Windows(100),
        rows=(df, [foreach_element("all_pos", F.col("v") > 0), exists_element("some_neg", F.col("v") < 0)]),
    )
    assert rows(word, "idx", "n_rows", "all_pos", "some_neg") == [
        (0, 1, True, False),
        (1, 0, True, False),
        (2, 1, False, True),
    ]


def test_shorter_side_ends_the_word(spark):
    word = letters(Windows(100), a=(timed(spark, [0, 350]), []), b=(timed(spark, [120]), []))
    assert rows(word, "idx", "last_idx", "n_a", "n_b") == [(0, 1, 1, 0), (1, 1, 0, 1)]


def test_no_letters_when_one_side_is_empty(spark):
    assert letters(Windows(100), a=(timed(spark, [0]), []), b=(timed(spark, []), [])).count() == 0


def test_cases_have_words_of_their_own(spark):
    a = spark.createDataFrame([(1, 0), (1, 250), (2, 120), (3, 0)], "case_id BIGINT, tms BIGINT")
    b = spark.createDataFrame([(1, 100), (2, 120)], "case_id BIGINT, tms BIGINT")
    word = letters(Windows(100), ["case_id"], a=(a, []), b=(b, []))
    assert rows(word, "case_id", "idx", "n_a", "n_b") == [(1, 0, 1, 0), (1, 1, 0, 1), (2, 0, 0, 0), (2, 1, 1, 1)]


def test_cap(spark):
    assert letters(Windows(10), cap=7, rows=(timed(spark, [0, 999]), [])).count() == 7


def test_rows_without_time_or_case_are_in_no_letter(spark):
    df = spark.createDataFrame([(None, 0), (1, None), (1, 5)], "case_id BIGINT, tms BIGINT")
    assert rows(letters(Windows(10), ["case_id"], rows=(df, [])), "case_id", "n_rows") == [(1, 1)]


def test_word_longer_than_a_spine_chunk(spark):
    word = letters(Windows(1), rows=(timed(spark, [0, 9000]), []))
    got = word.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.sum("n_rows")).first()
    assert tuple(got) == (9001, 0, 9000, 9001, 2)


def test_windows_of_ones_own(spark):
    """Months: neither equally long nor a slide apart."""

    class Months(Discretizer):
        def panes(self, df, tms="tms"):
            time = F.timestamp_millis(F.col(tms))
            return df.withColumn("_pane", ((F.year(time) - 2024) * 12 + F.month(time) - 1).cast("bigint"))

        def start_of(self, idx):
            return F.unix_millis(F.add_months(F.lit("2024-01-01").cast("date"), idx.cast("int")).cast("timestamp"))

    day = 86_400_000
    start = 1704067200000
    df = timed(spark, [start, start + 30 * day, start + 31 * day, start + 95 * day])
    word = letters(Months(), rows=(df, []))
    assert rows(word, "idx", "w_start", "n_rows") == [
        (0, start, 2), (1, start + 31 * day, 1), (2, start + 60 * day, 0), (3, start + 91 * day, 1)]
