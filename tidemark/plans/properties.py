"""The concrete properties: generated input, pipeline under test, formula.

Each takes the table of test cases (``case_id``) and gives one verdict per case. ``check`` runs the
property: :func:`for_all_cases` in batch, or with ``streaming=True`` bound for a streaming run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.levels import exceeds
from tidemark.functions.mixing import MODULUS, mix, pick_int, pick_tenths
from tidemark.functions.timed import field_from_event_time
from tidemark.operators import generators as g
from tidemark.operators.atoms import count_rows, foreach_element
from tidemark.operators.binding import bind_subset
from tidemark.operators.sets import missing_per_letter
from tidemark.operators.temporal import all_of, always, any_of, bind_next, coded, eventually, now, until
from tidemark.operators.windows import Windows
from tidemark.plans.harass import harass_max
from tidemark.plans.pollution import pollution1
from tidemark.plans.property import CASE, Property, for_all_cases
from tidemark.plans.tips import hourly_max, tips_per_hour_driver

Check = Callable[..., DataFrame]
SECOND, MINUTE, HOUR = 1000, 60_000, 3_600_000
GEN_MS = 50


# -- generated inputs ----------------------------------------------------------------------------


def _events(rows: DataFrame, windows: Windows) -> DataFrame:
    """Case, event time and payload only: what a stream would carry, and what is recorded."""
    return g.place_tumbling(rows, windows).drop("idx", "row", "h", "released")


def int_rows(cases: DataFrame, windows: int = 10) -> DataFrame:
    """10 to 50 whole numbers, negative and positive, in each 50 ms window."""
    rows = g.rows_n_to_m(g.always_windows(cases, windows), 10, 50)
    rows = rows.withColumn("value", mix(F.col("h") + F.lit(2)) * F.lit(2) - F.lit(MODULUS))
    return _events(rows, Windows(GEN_MS))


def sensor_rows(cases: DataFrame, windows: int, n: int, m: int, sensors: int, low: float, high: float) -> DataFrame:
    """n to m readings per second from a number of sensors, concentrations in low..high."""
    rows = g.rows_n_to_m(g.always_windows(cases, windows), n, m)
    rows = rows.withColumn("sensor_id", pick_int(mix(F.col("h") + F.lit(2)), 0, sensors - 1))
    rows = rows.withColumn("concentration", pick_tenths(mix(F.col("h") + F.lit(3)), low, high))
    return field_from_event_time(_events(rows, Windows(SECOND)), "timestamp")


def incident_rows(
    cases: DataFrame, window_ms: int, windows: int, n: int, m: int, low: float, high: float
) -> DataFrame:
    """n to m incidents per window in ten zones, danger in low..high."""
    rows = g.rows_n_to_m(g.always_windows(cases, windows), n, m)
    rows = rows.withColumn("zone_id", pick_int(mix(F.col("h") + F.lit(2)), 0, 9))
    rows = rows.withColumn("danger", pick_tenths(mix(F.col("h") + F.lit(3)), low, high))
    return _events(rows, Windows(window_ms))


def _arbitrary_fares(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("driver_id", mix(F.col("h") + F.lit(2)))
    return rows.withColumn("tip", pick_tenths(mix(F.col("h") + F.lit(3)), 0.1, 100.0))


def one_driver_rows(cases: DataFrame) -> DataFrame:
    """One fare of driver 42 in one of the first three quarter hours; much later, other fares."""
    once = _arbitrary_fares(g.rows_n(g.eventually_window(cases, 3), 1)).withColumn("driver_id", F.lit(42).cast("bigint"))
    others = _arbitrary_fares(g.rows_n_to_m(g.always_windows(cases, 1, seed=7), 1, 10))
    return _events(g.concat(once, g.later(others, 4), 3), Windows(15 * MINUTE))


def fixed_fare_rows(cases: DataFrame, factor: int = 6) -> DataFrame:
    """Ten drivers, each with a tip of ten times their id, in every part of an hour."""
    rows = g.rows_n(g.always_windows(cases, factor * 4 + 1), 10)
    rows = rows.withColumn("driver_id", F.col("row")).withColumn("tip", F.col("row") * F.lit(10.0))
    return _events(rows, Windows(HOUR // factor))


def any_fare_rows(cases: DataFrame, factor: int = 12) -> DataFrame:
    """1 to 50 fares in every part of an hour, for five hours."""
    rows = g.rows_n_to_m(g.always_windows(cases, 5 * factor), 1, 50)
    return _events(_arbitrary_fares(rows), Windows(HOUR // factor))


def alternating_rows(cases: DataFrame, timeout: int = 6) -> DataFrame:
    """Hours in which driver 1 has five fares and driver 2 two, then one hour the other way round.
    All tips are equal, so that the driver with more fares has the larger sum."""
    windows = g.until_windows(cases, timeout)
    many = g.rows_n(windows, 5).withColumn("driver_id", F.when(F.col("released"), F.lit(2)).otherwise(F.lit(1)))
    few = g.rows_n(windows, 2).withColumn("driver_id", F.when(F.col("released"), F.lit(1)).otherwise(F.lit(2)))
    rows = g.merge(many, few, 5).withColumn("driver_id", F.col("driver_id").cast("bigint")).withColumn("tip", F.lit(2.5))
    return _events(rows, Windows(HOUR))


# -- properties ----------------------------------------------------------------------------------


def prop_filter_nonneg(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """After dropping negative numbers all are >= 0 and occur in the input."""

    def subset(word: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
        cut = Windows(2 * GEN_MS)
        missing = missing_per_letter(cut.assign(output), cut.assign(source), ["tms", "value"], CASE)
        return word.join(missing, [*CASE, "idx"], "left").withColumn("is_subset", F.col("n_missing").isNull())

    prop = Property(
        Windows(2 * GEN_MS),
        always(all_of(now("not_negative"), now("is_subset")), 5),
        output_atoms=[foreach_element("not_negative", F.col("value") >= 0)],
        relate=subset,
    )
    return check(prop, int_rows(cases), lambda df: df.where(~(F.col("value") < 0)), cases)


def prop_time_monotone(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """The time of the next letter is never smaller."""
    prop = Property(Windows(2 * GEN_MS), always(bind_next(lambda this, nxt: this("w_start") <= nxt("w_start")), 4))
    return check(prop, int_rows(cases), lambda df: df, cases)


def prop_slide_step(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """Sliding windows advance by exactly one slide."""
    step = bind_next(lambda this, nxt: nxt("w_start") - this("w_start") == GEN_MS)
    prop = Property(Windows(2 * GEN_MS, GEN_MS), always(step, 4))
    return check(prop, int_rows(cases), lambda df: df, cases)


def prop_event_time_field(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """A field assigned from the event time equals it."""
    rows = field_from_event_time(int_rows(cases, 4), "timestamp")
    same = foreach_element("same", F.col("tms") == F.col("timestamp"))
    prop = Property(Windows(2 * GEN_MS), always(now("same"), 2), output_atoms=[same])
    return check(prop, rows, lambda df: df, cases)


def prop_high_never_ok(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """When all readings are over 180, no level is OK."""
    rows = sensor_rows(cases, 5, 10, 50, 10, 180.1, 1000.0)
    prop = Property(
        Windows(SECOND), always(now("not_ok"), 5), output_atoms=[foreach_element("not_ok", F.col("level") != "OK")]
    )
    return check(prop, rows, lambda df: pollution1(df, keys=CASE), cases)


def prop_high_eventually_alert(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """All sensors of a letter with a reading over 400 are flagged Alert together, now or within
    the next four letters."""
    cut = Windows(SECOND // 4)

    def detected(word: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
        high = source.where(exceeds(F.col("concentration"), 400.0))
        return bind_subset(word, high, output.where(F.col("level") == "Alert"), cut, ["sensor_id"], range(5), CASE)

    formula = always(any_of(*[coded(f"bound_{o}") for o in range(5)]), 10)
    prop = Property(cut, formula, relate=detected)
    rows = sensor_rows(cases, 5, 5, 10, 30, 500.0, 1000.0)
    return check(prop, rows, lambda df: pollution1(df, keys=CASE), cases)


def _never_safe(cases: DataFrame, rows: DataFrame, check: Check) -> DataFrame:
    prop = Property(
        Windows(HOUR), always(now("not_safe"), 20), output_atoms=[foreach_element("not_safe", F.col("level") != "Safe")]
    )
    return check(prop, rows, lambda df: harass_max(df, keys=CASE), cases)


def prop_danger_never_safe(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """When every danger is over 1, no zone is Safe."""
    return _never_safe(cases, incident_rows(cases, HOUR, 20, 15, 50, 1.1, 10.0), check)


def prop_danger_never_safe_fails(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """The same with few incidents and dangers from 0.5: most cases falsify it."""
    return _never_safe(cases, incident_rows(cases, HOUR, 20, 2, 5, 0.5, 10.0), check)


def prop_extreme_eventually_flagged(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """When a letter has dangers over 8, their zones are flagged Extreme together, now or within
    the next three letters."""
    cut = Windows(15 * MINUTE)
    extreme = exceeds(F.col("danger"), 8.0)

    def flagged(word: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
        late = output.where(F.col("level") == "Extreme")
        return bind_subset(word, source.where(extreme), late, cut, ["zone_id"], range(4), CASE)

    prop = Property(
        cut,
        always(now(F.col("n_extreme") > 0) >> any_of(*[coded(f"bound_{o}") for o in range(4)]), 1),
        input_atoms=[count_rows("n_extreme", extreme)],
        relate=flagged,
    )
    rows = incident_rows(cases, 30 * MINUTE, 2, 50, 50, 0.0, 10.0)
    return check(prop, rows, lambda df: harass_max(df, keys=CASE), cases)


def prop_one_driver_one_tip(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """With a single fare of driver 42, some letter has that driver as the only hourly maximum."""
    prop = Property(
        Windows(15 * MINUTE),
        eventually(all_of(now(F.col("n_output") == 1), now("is_42")), 4),
        output_atoms=[foreach_element("is_42", F.col("driver_id") == 42)],
    )
    return check(prop, one_driver_rows(cases), lambda df: hourly_max(df, keys=CASE), cases)


def prop_tips_summed_by_hour(cases: DataFrame, check: Check = for_all_cases, factor: int = 6) -> DataFrame:
    """Six tips of ten times the driver id make sixty times the driver id per hour."""
    expected = F.col("driver_id") * F.lit(10.0 * factor)
    prop = Property(
        Windows(HOUR),
        always(now("right_sum"), 4),
        output_atoms=[foreach_element("right_sum", F.col("tips") == expected)],
    )
    return check(prop, fixed_fare_rows(cases, factor), lambda df: tips_per_hour_driver(df, keys=CASE), cases)


def prop_single_hourly_max(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """Every hour has exactly one maximum."""
    prop = Property(Windows(HOUR), always(now(F.col("n_output") == 1), 5))
    return check(prop, any_fare_rows(cases), lambda df: hourly_max(df, keys=CASE), cases)


def prop_driver_until_driver(cases: DataFrame, check: Check = for_all_cases) -> DataFrame:
    """Driver 1 is on top until driver 2 is."""
    prop = Property(
        Windows(HOUR),
        until(now("one_top"), now("two_top"), 6),
        output_atoms=[
            foreach_element("one_top", F.col("driver_id") == 1),
            foreach_element("two_top", F.col("driver_id") == 2),
        ],
    )
    return check(prop, alternating_rows(cases), lambda df: hourly_max(df, keys=CASE), cases)


PROPERTIES: dict[str, Callable[..., DataFrame]] = {
    name: fn for name, fn in list(globals().items()) if name.startswith("prop_")
}
