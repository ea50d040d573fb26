"""Temporal formulas, binding and case verdicts over the letters of every sensor."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import sql
from suite.events import SIX_HOURS
from suite.letters import BY, HOURLY, hourly_levels
from suite.registry import DAY, HOUR, T0, query
from tidemark.functions.levels import exceeds
from tidemark.functions.timed import add_timestamp
from tidemark.operators.atoms import aggregate, exists_element, foreach_element
from tidemark.operators.binding import bind_reaches, bind_subset
from tidemark.operators.letters import letters
from tidemark.operators.sessions import GapWindows
from tidemark.operators.temporal import (
    Formula,
    all_of,
    always,
    any_of,
    bind_next,
    case_verdict,
    coded,
    evaluate,
    eventually,
    next_,
    now,
    until,
    with_verdict,
)
from tidemark.operators.windows import Windows
from tidemark.plans.harass import harass_max
from tidemark.plans.pollution import pollution1
from tidemark.plans.property import Property, for_all_cases
from tidemark.plans.tips import hourly_max
from tidemark.sources.tables import events, fares, incidents, sensors


def sensor_word(spark, sf_dir, *names: str) -> DataFrame:
    """Six-hour letters of every sensor with the assertions a formula uses."""
    atoms = {
        "no_alert": foreach_element("no_alert", F.col("level") != "Alert"),
        "all_ok": foreach_element("all_ok", F.col("level") == "OK"),
        "some_alert": exists_element("some_alert", F.col("level") == "Alert"),
    }
    output = (hourly_levels(spark, sf_dir), [atoms[name] for name in names])
    return letters(SIX_HOURS, BY, input=(sensors(spark, sf_dir), []), output=output)


SENSOR_WORD = (
    f"{sql.SENSORS}, p1 AS ({sql.pollution1()}), i AS ({sql.side('sensors', 'count(*) AS ni', BY)}), "
    + "o AS ("
    + sql.side(
        "p1",
        "count(*) AS no, bool_and(level <> 'Alert') AS na, bool_and(level = 'OK') AS ok, bool_or(level = 'Alert') AS sa",
        BY,
    )
    + "), word AS ("
    + sql.word(
        ["i", "o"],
        "coalesce(ni, 0) AS n_input, coalesce(no, 0) AS n_output, coalesce(na, true) AS no_alert, "
        "coalesce(ok, true) AS all_ok, coalesce(sa, false) AS some_alert",
        BY,
    )
    + ")"
)


def _sql(value: str, source: str = "word") -> str:
    return f"WITH {SENSOR_WORD} SELECT sensor_id, idx, {sql.verdict(value)} AS verdict FROM {source}"


def _evaluated(spark, sf_dir, formula: Formula, *names: str) -> DataFrame:
    result = with_verdict(evaluate(sensor_word(spark, sf_dir, *names), formula, BY))
    return result.select("sensor_id", "idx", "verdict")


NO_ALERT, SOME_ALERT = sql.bit("no_alert"), sql.bit("some_alert")


@query("t_now", _sql(NO_ALERT))
def t_now(spark, sf_dir):
    return _evaluated(spark, sf_dir, now("no_alert"), "no_alert")


@query("t_next", _sql(f"coalesce(lead({SOME_ALERT}) OVER (PARTITION BY sensor_id ORDER BY idx), 0)"))
def t_next(spark, sf_dir):
    return _evaluated(spark, sf_dir, next_(now("some_alert")), "some_alert")


@query("t_always", _sql(sql.always(NO_ALERT, 4, BY)))
def t_always(spark, sf_dir):
    return _evaluated(spark, sf_dir, always(now("no_alert"), 4), "no_alert")


@query("t_eventually", _sql(sql.eventually(SOME_ALERT, 4, BY)))
def t_eventually(spark, sf_dir):
    return _evaluated(spark, sf_dir, eventually(now("some_alert"), 4), "some_alert")


@query("t_until", _sql(sql.until("all_ok", "some_alert", 4, BY)))
def t_until(spark, sf_dir):
    return _evaluated(spark, sf_dir, until(now("all_ok"), now("some_alert"), 4), "all_ok", "some_alert")


@query("t_at", _sql(f"least({sql.bit('n_input >= 2')}, {sql.bit('n_output >= 2')})"))
def t_at(spark, sf_dir):
    """The same assertion at the input and at the output side of a letter."""
    return _evaluated(spark, sf_dir, all_of(*[now(F.col(side) >= 2) for side in ("n_input", "n_output")]))


@query("t_and_all", _sql(f"least({NO_ALERT}, {sql.bit('n_output > 0')}, {sql.bit('n_input >= 2')})"))
def t_and_all(spark, sf_dir):
    formula = all_of(now("no_alert"), now(F.col("n_output") > 0), now(F.col("n_input") >= 2))
    return _evaluated(spark, sf_dir, formula, "no_alert")


@query("t_or", _sql(f"greatest({sql.bit('some_alert')}, {sql.bit('n_output = 0')})"))
def t_or(spark, sf_dir):
    return _evaluated(spark, sf_dir, now("some_alert") | now(F.col("n_output") == 0), "some_alert")


@query("t_implies", _sql(f"greatest(-({sql.bit('n_output > 0')}), {SOME_ALERT})"))
def t_implies(spark, sf_dir):
    return _evaluated(spark, sf_dir, now(F.col("n_output") > 0) >> now("some_alert"), "some_alert")


@query(
    "t_nested",
    _sql(sql.always("e", 3, BY), f"(SELECT *, {sql.eventually(SOME_ALERT, 8, BY)} AS e FROM word)"),
)
def t_nested(spark, sf_dir):
    return _evaluated(spark, sf_dir, always(eventually(now("some_alert"), 8), 3), "some_alert")


@query(
    "t_always_count1",
    f"""
    WITH {sql.FARES}, top AS ({sql.top_tips()}), i AS ({sql.side('fares', 'count(*) AS ni', [], sql.letter_index(HOUR))}),
    o AS ({sql.side('top', 'count(*) AS no', [], sql.letter_index(HOUR))}),
    word AS ({sql.word(['i', 'o'], 'coalesce(no, 0) AS n_output', step=HOUR)})
    SELECT idx, {sql.verdict(sql.always(sql.bit('n_output = 1'), 5))} AS verdict FROM word
    """,
)
def t_always_count1(spark, sf_dir):
    source = fares(spark, sf_dir)
    word = letters(HOURLY, input=(source, []), output=(add_timestamp(hourly_max(source)), []))
    return with_verdict(evaluate(word, always(now(F.col("n_output") == 1), 5))).select("idx", "verdict")


def _time_word_sql(value: str, size: int, slide: int) -> str:
    return f"""
    WITH {sql.SENSORS}, s AS ({sql.side('sensors', 'count(*) AS n', BY, sql.slide_indexes(size, slide))}),
    word AS ({sql.word(['s'], 'n', BY, slide)}),
    steps AS (SELECT *, {value} AS v FROM (SELECT *, lead(w_start) OVER (PARTITION BY sensor_id ORDER BY idx) AS nxt FROM word))
    SELECT sensor_id, idx, {sql.verdict(sql.always('v', 4, BY))} AS verdict FROM steps
    """


def _time_word(spark, sf_dir, condition) -> DataFrame:
    word = letters(Windows(12 * HOUR, 6 * HOUR, T0), BY, rows=(sensors(spark, sf_dir), []))
    result = with_verdict(evaluate(word, always(bind_next(condition), 4), BY))
    return result.select("sensor_id", "idx", "verdict")


@query(
    "time_monotone",
    _time_word_sql("CASE WHEN nxt IS NULL THEN 0 WHEN w_start <= nxt THEN 1 ELSE -1 END", 12 * HOUR, 6 * HOUR),
)
def time_monotone(spark, sf_dir):
    return _time_word(spark, sf_dir, lambda this, nxt: this("w_start") <= nxt("w_start"))


@query(
    "slide_step",
    _time_word_sql(
        f"CASE WHEN nxt IS NULL THEN 0 WHEN nxt - w_start = {6 * HOUR} THEN 1 ELSE -1 END", 12 * HOUR, 6 * HOUR
    ),
)
def slide_step(spark, sf_dir):
    return _time_word(spark, sf_dir, lambda this, nxt: nxt("w_start") - this("w_start") == 6 * HOUR)


@query(
    "safety_harass",
    f"""
    WITH {sql.INCIDENTS}, h AS ({sql.harass()}),
    i AS ({sql.side('incidents', 'count(*) AS ni', ['zone_id'])}),
    o AS ({sql.side('h', "bool_and(level <> 'Safe') AS ns", ['zone_id'])}),
    word AS ({sql.word(['i', 'o'], 'coalesce(ns, true) AS not_safe', ['zone_id'])})
    SELECT zone_id, idx, {sql.verdict(sql.always(sql.bit('not_safe'), 20, ['zone_id']))} AS verdict FROM word
    """,
)
def safety_harass(spark, sf_dir):
    source = incidents(spark, sf_dir)
    safe = foreach_element("not_safe", F.col("level") != "Safe")
    word = letters(SIX_HOURS, ["zone_id"], input=(source, []), output=(add_timestamp(harass_max(source)), [safe]))
    result = with_verdict(evaluate(word, always(now("not_safe"), 20), ["zone_id"]))
    return result.select("zone_id", "idx", "verdict")


@query(
    "bound_alert_liveness",
    f"""
    WITH {sql.SENSORS}, daily AS ({sql.pollution1(size=DAY)}),
    i AS ({sql.side('sensors', 'count(*) AS ni')}), o AS ({sql.side('daily', 'count(*) AS no')}),
    word AS ({sql.word(['i', 'o'], '1 AS one')}),
    early AS (SELECT {sql.letter_index()} AS idx, sensor_id FROM sensors WHERE concentration > 400),
    late AS (SELECT {sql.letter_index()} AS idx, sensor_id FROM daily WHERE level = 'Alert'),
    b AS ({sql.bound('word', 'early', 'late', 'sensor_id', range(3))})
    SELECT idx, bound_0, bound_1, bound_2,
           {sql.verdict(sql.always('greatest(bound_0, bound_1, bound_2)', 2))} AS verdict FROM b
    """,
)
def bound_alert_liveness(spark, sf_dir):
    """Sensors over 400 in a letter are all flagged Alert in that letter or together in one of the
    next two."""
    source = sensors(spark, sf_dir)
    levels = add_timestamp(pollution1(source, "1 day"))
    word = letters(SIX_HOURS, input=(source, []), output=(levels, []))
    high = source.where(exceeds(F.col("concentration"), 400.0))
    bound = bind_subset(word, high, levels.where(F.col("level") == "Alert"), SIX_HOURS, ["sensor_id"], range(3))
    names = ["bound_0", "bound_1", "bound_2"]
    result = with_verdict(evaluate(bound, always(any_of(*[coded(n) for n in names]), 2)))
    return result.select("idx", *[F.col(n).cast("int").alias(n) for n in names], "verdict")


_EXTREME_BY = ["zone_id"]


@query(
    "bound_extreme_liveness",
    f"""
    WITH {sql.INCIDENTS}, daily AS ({sql.harass(size=DAY)}),
    i AS ({sql.side('incidents', 'bool_or(danger > 8) AS x')}), o AS ({sql.side('daily', 'count(*) AS no')}),
    word AS ({sql.word(['i', 'o'], 'coalesce(x, false) AS any_extreme')}),
    early AS (SELECT {sql.letter_index()} AS idx, zone_id FROM incidents WHERE danger > 8),
    late AS (SELECT {sql.letter_index()} AS idx, zone_id FROM daily WHERE level = 'Extreme'),
    b AS ({sql.bound('word', 'early', 'late', 'zone_id', range(4))})
    SELECT idx, {sql.verdict(f"greatest(-({sql.bit('any_extreme')}), bound_0, bound_1, bound_2, bound_3)")} AS verdict FROM b
    """,
)
def bound_extreme_liveness(spark, sf_dir):
    """When a letter has zones in extreme danger, they are flagged now or together within three letters."""
    source = incidents(spark, sf_dir)
    extreme = exceeds(F.col("danger"), 8.0)
    levels = add_timestamp(harass_max(source, "1 day"))
    word = letters(SIX_HOURS, input=(source, [exists_element("any_extreme", extreme)]), output=(levels, []))
    late = levels.where(F.col("level") == "Extreme")
    bound = bind_subset(word, source.where(extreme), late, SIX_HOURS, ["zone_id"], range(4))
    formula = now("any_extreme") >> any_of(*[coded(f"bound_{o}") for o in range(4)])
    return with_verdict(evaluate(bound, formula)).select("idx", "verdict")


CASE_SQL = f"""
    WITH {SENSOR_WORD}, v AS (SELECT sensor_id, idx, {sql.always(NO_ALERT, 4, BY)} AS v FROM word)
    SELECT sensor_id, {sql.verdict('coalesce(v, 0)')} AS verdict, coalesce(v, 0) >= 0 AS passed
    FROM (SELECT DISTINCT sensor_id FROM sensors) LEFT JOIN (SELECT * FROM v WHERE idx = 0) USING (sensor_id)
    """


@query("case_verdict", CASE_SQL)
def case_verdict_query(spark, sf_dir):
    """One verdict per sensor: the formula's value at its first letter."""
    formula = always(now("no_alert"), 4)
    word = sensor_word(spark, sf_dir, "no_alert")
    evaluated = evaluate(word, formula, BY)
    return case_verdict(evaluated, sensors(spark, sf_dir), BY)


@query("property_cases", f"SELECT sensor_id AS case_id, verdict, passed FROM ({CASE_SQL})")
def property_cases(spark, sf_dir):
    """A property over recorded data: every sensor is a case."""
    source = sensors(spark, sf_dir).withColumn("case_id", F.col("sensor_id"))
    prop = Property(
        SIX_HOURS,
        always(now("no_alert"), 4),
        output_atoms=[foreach_element("no_alert", F.col("level") != "Alert")],
    )
    subject = partial(pollution1, size="1 hour", keys=["case_id"])
    return for_all_cases(prop, source, subject, source, record=False)


_REACHED = [
    f"""LEFT JOIN (SELECT a.idx, true AS miss_{o} FROM tops a
        LEFT JOIN tops b ON b.event_type = a.event_type AND b.idx = a.idx + {o}
        GROUP BY a.idx HAVING NOT bool_and(coalesce(b.top >= a.top, false))) m{o} USING (idx)"""
    for o in (1, 2, 3)
]
_REACHED_VALUES = ", ".join(
    f"CASE WHEN idx + {o} > last_idx THEN 0 WHEN miss_{o} THEN -1 ELSE 1 END AS bound_{o}" for o in (1, 2, 3)
)


@query(
    "bound_reaches_level",
    f"""
    WITH timed AS (SELECT *, epoch_us(ts) // 1000 AS tms FROM events),
    i AS ({sql.side('timed', 'count(*) AS n')}), word AS ({sql.word(['i'], 'n')}),
    tops AS (SELECT {sql.letter_index()} AS idx, event_type, max(value) AS top FROM timed GROUP BY ALL),
    b AS (SELECT idx, last_idx, {_REACHED_VALUES} FROM word {' '.join(_REACHED)})
    SELECT idx, bound_1, bound_2, bound_3,
           {sql.verdict(sql.eventually('greatest(bound_1, bound_2, bound_3)', 2))} AS verdict FROM b
    """,
)
def bound_reaches_level(spark, sf_dir):
    """The highest value of every kind of event in a letter is reached by that kind in one of the next three."""
    rows = add_timestamp(events(spark, sf_dir))
    word = letters(SIX_HOURS, rows=(rows, []))
    bound = bind_reaches(word, rows, rows, SIX_HOURS, ["event_type"], "value", (1, 2, 3))
    formula = eventually(any_of(*[coded(f"bound_{o}") for o in (1, 2, 3)]), 2)
    result = with_verdict(evaluate(bound, formula))
    values = [F.col(f"bound_{o}").cast("int").alias(f"bound_{o}") for o in (1, 2, 3)]
    return result.select("idx", *values, "verdict")


_GAP = 36 * HOUR


@query(
    "discretize_by_gap",
    f"""
    WITH {sql.SENSORS},
    marked AS (SELECT *, coalesce(tms - lag(tms) OVER w > {_GAP}, false) AS opens FROM sensors
               WINDOW w AS (PARTITION BY sensor_id ORDER BY tms)),
    numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY sensor_id ORDER BY tms) AS idx FROM marked),
    word AS (SELECT sensor_id, idx::BIGINT AS idx, count(*) AS n_rows, min(tms) AS first_ms, max(tms) AS last_ms,
             bool_or(concentration > 400) AS high FROM numbered GROUP BY ALL)
    SELECT sensor_id, idx, n_rows, first_ms, last_ms, {sql.verdict(sql.eventually(sql.bit('high'), 2, BY))} AS verdict FROM word
    """,
)
def discretize_by_gap(spark, sf_dir):
    """Letters that end where a sensor is silent for a day and a half: is one of two in a row above 400?"""
    rows = sensors(spark, sf_dir)
    atoms = [
        aggregate("first_ms", F.col("tms"), F.min),
        aggregate("last_ms", F.col("tms"), F.max),
        exists_element("high", exceeds(F.col("concentration"), 400.0)),
    ]
    word = letters(GapWindows(_GAP, ("sensor_id",)), BY, rows=(rows, atoms))
    result = with_verdict(evaluate(word, eventually(now("high"), 2), BY))
    return result.select("sensor_id", "idx", "n_rows", "first_ms", "last_ms", "verdict")
