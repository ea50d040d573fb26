"""Streaming queries: each runs a stream over the events file to its end, records the result and
is compared with the batch SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import sql
from suite.events import HOURLY_MAX_SQL, POLLUTION2_SQL, POLLUTION3_SQL, SIX_HOURS, shown_sensors
from suite.formulas import BY, CASE_SQL, NO_ALERT, SENSOR_WORD, SOME_ALERT
from suite.generated import QUARTER, cases
from suite.registry import HOUR, ORACLES, query
from tidemark.functions.timed import add_timestamp
from tidemark.operators import generators as g
from tidemark.operators.atoms import exists_element, foreach_element
from tidemark.operators.letters import letters, word_ends
from tidemark.operators.temporal import Formula, always, case_verdict, evaluate, eventually, next_, now, until, with_verdict
from tidemark.operators.windows import Windows
from tidemark.plans import harass, pollution, tips
from tidemark.plans.properties import PROPERTIES
from tidemark.plans.property import for_all_cases
from tidemark.sources.tables import fares, incidents, sensors
from tidemark.streaming.levels import level_changes
from tidemark.streaming.monitor import complete_verdicts, monitor_always, monitor_eventually, monitor_formula
from tidemark.streaming.recorder import record_stream, record_with_timestamps, replay


@query(
    "stream_replay",
    f"""
    WITH {sql.CASES} SELECT case_id, idx, row, tms
    FROM ({sql.placed(sql.rows(sql.always_windows(5), 3, 9), QUARTER)}) WHERE h % 3 <> 0
    """,
)
def stream_replay(spark, sf_dir):
    """Generated test cases as a stream through a stateless pipeline."""
    rows = g.place_tumbling(g.rows_n_to_m(g.always_windows(cases(spark, sf_dir), 5), 3, 9), Windows(QUARTER))
    out = record_stream(replay(rows, "cases"), lambda s: s.where(F.col("h") % 3 != 0), "replayed", flush=False)
    return out.select("case_id", "idx", "row", "tms")


@query(
    "stream_pollution1",
    f"WITH {sql.SENSORS} SELECT w_end, sensor_id, level FROM ({sql.pollution1()})",
)
def stream_pollution1(spark, sf_dir):
    source = sensors(spark, sf_dir, streaming=True)
    return record_stream(source, lambda s: pollution.pollution1(s, "1 hour"), "pollution1").drop("ts")


@query("stream_pollution2", POLLUTION2_SQL)
def stream_pollution2(spark, sf_dir):
    source = sensors(spark, sf_dir, streaming=True)
    return record_stream(source, lambda s: pollution.pollution2(s, "3 hours", "1 hour"), "pollution2").drop("ts")


@query("stream_pollution3", POLLUTION3_SQL)
def stream_pollution3(spark, sf_dir):
    source = sensors(spark, sf_dir, streaming=True)
    spans = record_stream(source, lambda s: pollution.sensor_spans(s, "1 day", "3 days", "1 day"), "spans")
    return shown_sensors(pollution.span_levels(spans))


@query("stream_harass_max", f"WITH {sql.INCIDENTS} SELECT w_end, zone_id, level FROM ({sql.harass()})")
def stream_harass_max(spark, sf_dir):
    return record_stream(incidents(spark, sf_dir, streaming=True), harass.harass_max, "harass").drop("ts")


@query("stream_hourly_max", HOURLY_MAX_SQL)
def stream_hourly_max(spark, sf_dir):
    out = record_stream(fares(spark, sf_dir, streaming=True), tips.hourly_max, "hourly-max")
    return out.drop("ts").withColumn("tips", F.round("tips", 4))


@query(
    "stream_flush",
    f"""
    WITH {sql.FARES}, all_tips AS ({sql.driver_tips()})
    SELECT w_end, driver_id, round(tips, 4) AS tips,
           w_end <= (SELECT max(tms) FROM fares) AS before_flush FROM all_tips
    """,
)
def stream_flush(spark, sf_dir):
    """Which windows the end-of-input flush adds to what the watermark had closed before."""
    flushed = record_stream(fares(spark, sf_dir, streaming=True), tips.tips_per_hour_driver, "flushed")
    early = record_stream(fares(spark, sf_dir, streaming=True), tips.tips_per_hour_driver, "unflushed", flush=False)
    closed = early.select("w_end", "driver_id", F.lit(True).alias("closed"))
    marked = flushed.join(closed, ["w_end", "driver_id"], "left")
    return marked.select(
        "w_end", "driver_id", F.round("tips", 4).alias("tips"), F.col("closed").isNotNull().alias("before_flush")
    )


@query("record_roundtrip", f"WITH {sql.SENSORS} SELECT event_id, tms, sensor_id, concentration FROM sensors")
def record_roundtrip(spark, sf_dir):
    source = sensors(spark, sf_dir, streaming=True).drop("tms")
    out = record_with_timestamps(source, lambda s: s, "recorded", flush=False)
    return out.select("event_id", "tms", "sensor_id", "concentration")


@query("stream_record_evaluate", CASE_SQL)
def stream_record_evaluate(spark, sf_dir):
    """Record the input and the output of a pipeline as streams, then evaluate in batch."""
    source = sensors(spark, sf_dir, streaming=True)
    recorded = record_with_timestamps(source, lambda s: s, "input", flush=False)
    output = record_with_timestamps(source, lambda s: pollution.pollution1(s, "1 hour"), "output")
    word = letters(
        SIX_HOURS,
        BY,
        input=(recorded, []),
        output=(output, [foreach_element("no_alert", F.col("level") != "Alert")]),
    )
    return case_verdict(evaluate(word, always(now("no_alert"), 4), BY), recorded, BY)


# A monitor takes strict windows; the events have no rows before the first letter.
STRICT = Windows(SIX_HOURS.size_ms, start_ms=SIX_HOURS.start_ms, strict=True)


def _monitored(spark, sf_dir, monitor, level_predicate, horizon: int, empty: bool) -> DataFrame:
    def verdicts(stream: DataFrame) -> DataFrame:
        return monitor(pollution.pollution1(stream, "1 hour"), level_predicate, STRICT, horizon, BY)

    frames = record_stream(sensors(spark, sf_dir, streaming=True), verdicts, "monitor")
    ends = word_ends(sensors(spark, sf_dir), STRICT, BY)
    return with_verdict(complete_verdicts(frames, ends, horizon, empty, BY))


@query(
    "stream_monitor_always",
    f"WITH {SENSOR_WORD} SELECT sensor_id, idx, {sql.verdict(sql.always(NO_ALERT, 4, BY))} AS verdict FROM word",
)
def stream_monitor_always(spark, sf_dir):
    return _monitored(spark, sf_dir, monitor_always, F.col("level") != "Alert", 4, True)


@query(
    "stream_monitor_eventually",
    f"WITH {SENSOR_WORD} SELECT sensor_id, idx, {sql.verdict(sql.eventually(SOME_ALERT, 4, BY))} AS verdict FROM word",
)
def stream_monitor_eventually(spark, sf_dir):
    return _monitored(spark, sf_dir, monitor_eventually, F.col("level") == "Alert", 4, False)


_LEVEL_ATOMS = "bool_and(level = 'OK') AS ok, bool_or(level = 'Alert') AS sa"
_OUTPUT_WORD = (
    f"{sql.SENSORS}, p1 AS ({sql.pollution1()}), o AS ({sql.side('p1', _LEVEL_ATOMS, BY)}), "
    f"word AS ({sql.word(['o'], 'coalesce(ok, true) AS all_ok, coalesce(sa, false) AS some_alert', BY)})"
)


UNTIL_SQL = f"WITH {_OUTPUT_WORD} SELECT sensor_id, idx, {sql.verdict(sql.until('all_ok', 'some_alert', 4, BY))} AS verdict FROM word"


@query("stream_record_until", UNTIL_SQL)
def stream_record_until(spark, sf_dir):
    """A formula with until: the output is recorded as a stream and evaluated in batch."""
    source = sensors(spark, sf_dir, streaming=True)
    output = record_with_timestamps(source, lambda s: pollution.pollution1(s, "1 hour"), "until")
    atoms = [
        foreach_element("all_ok", F.col("level") == "OK"),
        exists_element("some_alert", F.col("level") == "Alert"),
    ]
    word = letters(SIX_HOURS, BY, output=(output, atoms))
    return with_verdict(evaluate(word, until(now("all_ok"), now("some_alert"), 4), BY)).select("sensor_id", "idx", "verdict")


@query(
    "stream_filtered_windows",
    f"""
    WITH {sql.SENSORS}, high AS (SELECT * FROM sensors WHERE concentration > 300 AND sensor_id % 3 = 1)
    SELECT w_end, sensor_id, level FROM ({sql.pollution1('high')})
    """,
)
def stream_filtered_windows(spark, sf_dir):
    """A pipeline that filters before its windows, flushed to its last window."""

    def high(stream: DataFrame) -> DataFrame:
        return pollution.pollution1(stream.where((F.col("concentration") > 300) & (F.col("sensor_id") % 3 == 1)), "1 hour")

    return record_stream(sensors(spark, sf_dir, streaming=True), high, "filtered").drop("ts")


@query("stream_property_cases", ORACLES["prop_danger_never_safe_fails"])
def stream_property_cases(spark, sf_dir):
    """A property over generated cases with the pipeline under test run as a stream."""
    check = partial(for_all_cases, streaming=True)
    return PROPERTIES["prop_danger_never_safe_fails"](cases(spark, sf_dir), check)


_SILENCE = 24 * HOUR


@query(
    "stream_level_changes",
    f"""
    WITH {sql.SENSORS}, p1 AS ({sql.pollution1()}),
    steps AS (
        SELECT *, lag(level) OVER w AS prev, lag(tms) OVER w AS prev_tms, lead(tms) OVER w AS next_tms
        FROM p1 WINDOW w AS (PARTITION BY sensor_id ORDER BY tms)
    ),
    heard AS (SELECT *, CASE WHEN tms - prev_tms <= {_SILENCE} THEN prev END AS before FROM steps)
    SELECT sensor_id, tms AS at, before, level FROM heard WHERE before IS DISTINCT FROM level
    UNION ALL
    SELECT sensor_id, tms + {_SILENCE}, level, NULL FROM steps
    WHERE next_tms IS NULL OR next_tms - tms > {_SILENCE}
    """,
)
def stream_level_changes(spark, sf_dir):
    """A function with state and a timer: a row when a sensor's level changes or nothing comes for a day."""

    def changes(stream: DataFrame) -> DataFrame:
        return level_changes(add_timestamp(pollution.pollution1(stream, "1 hour")), _SILENCE, BY)

    return record_stream(sensors(spark, sf_dir, streaming=True), changes, "changes")


def _watched(spark, sf_dir, formula: Formula) -> DataFrame:
    """Verdicts of a formula on the hourly levels of every sensor, told while the stream runs."""
    atoms = [
        foreach_element("all_ok", F.col("level") == "OK"),
        exists_element("some_alert", F.col("level") == "Alert"),
    ]

    def verdicts(stream: DataFrame) -> DataFrame:
        return monitor_formula(pollution.pollution1(stream, "1 hour"), formula, STRICT, atoms, BY)

    return with_verdict(record_stream(sensors(spark, sf_dir, streaming=True), verdicts, "watched"))


@query("stream_monitor_until", UNTIL_SQL)
def stream_monitor_until(spark, sf_dir):
    return _watched(spark, sf_dir, until(now("all_ok"), now("some_alert"), 4))


_NEXT_OK = f"coalesce(lead({sql.bit('all_ok')}) OVER (PARTITION BY sensor_id ORDER BY idx), 0)"


@query(
    "stream_monitor_nested",
    f"""
    WITH {_OUTPUT_WORD}, inner_values AS (SELECT *, {sql.eventually(SOME_ALERT, 8, BY)} AS e, {_NEXT_OK} AS n FROM word)
    SELECT sensor_id, idx, {sql.verdict(f"greatest({sql.always('e', 3, BY)}, -({SOME_ALERT}), n)")} AS verdict
    FROM inner_values
    """,
)
def stream_monitor_nested(spark, sf_dir):
    """An alert is followed by a quiet letter, or alerts keep coming."""
    alert = now("some_alert")
    return _watched(spark, sf_dir, (alert >> next_(now("all_ok"))) | always(eventually(alert, 8), 3))
