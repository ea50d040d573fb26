"""Discretisers, assertions and reports on letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import sql
from suite.events import SIX_HOURS, alert_rows
from suite.registry import DAY, HOUR, T0, query
from tidemark.functions.timed import add_timestamp
from tidemark.operators.atoms import (
    aggregate,
    be_empty,
    be_non_empty,
    exists_context,
    exists_element,
    exists_projection,
    foreach_context,
    foreach_element,
    foreach_projection,
    mean_of,
    mean_value,
)
from tidemark.operators.letters import letters
from tidemark.operators.order_statistics import letter_percentile, window_median
from tidemark.operators.reports import failing_examples, subset_examples, window_head
from tidemark.operators.sets import missing_per_letter
from tidemark.operators.temporal import always, evaluate, now, with_verdict
from tidemark.operators.windows import Windows
from tidemark.plans.pollution import pollution1
from tidemark.sources.tables import events, sensors

HOURLY = Windows(HOUR, start_ms=T0)
BY = ["sensor_id"]


def hourly_levels(spark, sf_dir) -> DataFrame:
    return add_timestamp(pollution1(sensors(spark, sf_dir), "1 hour"))


def only(word: DataFrame, *columns: str) -> DataFrame:
    return word.select(*columns)


# -- discretisers --------------------------------------------------------------------------------


def _counts_sql(source: str, size: int, slide: int | None) -> str:
    step = slide or size
    if slide is None or slide > size:
        inside = f"({'tms'} - {T0}) % {step} < {size}"
        sparse = f"SELECT idx, count(*) FILTER ({inside}) AS n FROM (SELECT *, {sql.letter_index(step)} AS idx FROM {source}) GROUP BY idx"
    else:
        sparse = sql.side(source, "count(*) AS n", idx=sql.slide_indexes(size, slide))
    return (
        f"WITH {sql.SENSORS}, s AS ({sparse}), word AS ({sql.word(['s'], 'coalesce(n, 0) AS n_rows', step=step)}) "
        "SELECT idx, w_start, n_rows FROM word"
    )


def _counts(spark, sf_dir, windows: Windows) -> DataFrame:
    word = letters(windows, rows=(sensors(spark, sf_dir), []))
    return only(word, "idx", "w_start", "n_rows")


@query("discretize_tumbling", _counts_sql("sensors", HOUR, None))
def discretize_tumbling(spark, sf_dir):
    return _counts(spark, sf_dir, HOURLY)


@query("discretize_sliding", _counts_sql("sensors", 12 * HOUR, 5 * HOUR))
def discretize_sliding(spark, sf_dir):
    return _counts(spark, sf_dir, Windows(12 * HOUR, 5 * HOUR, T0))


@query("discretize_hopping_gaps", _counts_sql("sensors", 6 * HOUR, 8 * HOUR))
def discretize_hopping_gaps(spark, sf_dir):
    return _counts(spark, sf_dir, Windows(6 * HOUR, 8 * HOUR, T0))


@query(
    "discretize_rows",
    f"WITH {sql.SENSORS} SELECT event_id, {sql.slide_indexes(12 * HOUR, 6 * HOUR)} AS idx FROM sensors",
)
def discretize_rows(spark, sf_dir):
    return Windows(12 * HOUR, 6 * HOUR, T0).assign(sensors(spark, sf_dir)).select("event_id", "idx")


@query(
    "letter_count",
    f"""
    WITH {sql.SENSORS}, s AS ({sql.side('sensors', 'count(*) AS n', BY)}),
    word AS ({sql.word(['s'], 'coalesce(n, 0) AS n_rows', BY)})
    SELECT sensor_id, idx, w_start, n_rows FROM word
    """,
)
def letter_count(spark, sf_dir):
    word = letters(SIX_HOURS, BY, rows=(sensors(spark, sf_dir), []))
    return only(word, "sensor_id", "idx", "w_start", "n_rows")


@query(
    "letter_cap",
    f"""
    WITH {sql.SENSORS}, s AS ({sql.side('sensors', 'count(*) AS n', idx=sql.letter_index(HOUR))}),
    word AS ({sql.word(['s'], 'coalesce(n, 0) AS n_rows', step=HOUR, cap=100)})
    SELECT idx, w_start, n_rows FROM word
    """,
)
def letter_cap(spark, sf_dir):
    word = letters(HOURLY, cap=100, rows=(sensors(spark, sf_dir), []))
    return only(word, "idx", "w_start", "n_rows")


_ZIP_SIDES = (
    f"{sql.SENSORS}, p1 AS ({sql.pollution1()}), i AS ({sql.side('sensors', 'count(*) AS ni', BY)}), "
    f"o AS ({sql.side('p1', 'count(*) AS no', BY)})"
)


@query(
    "letters_zip",
    f"""
    WITH {_ZIP_SIDES},
    word AS ({sql.word(['i', 'o'], 'coalesce(ni, 0) AS n_input, coalesce(no, 0) AS n_output', BY)})
    SELECT sensor_id, idx, w_start, n_input, n_output FROM word
    """,
)
def letters_zip(spark, sf_dir):
    word = letters(SIX_HOURS, BY, input=(sensors(spark, sf_dir), []), output=(hourly_levels(spark, sf_dir), []))
    return only(word, "sensor_id", "idx", "w_start", "n_input", "n_output")


# -- assertions ----------------------------------------------------------------------------------


def _assertion_sql(source: str, aggregate: str, empty: str, by=BY, size: int = 6 * HOUR, more: str = "") -> str:
    keys = sql.cols(by)
    return f"""
    WITH {sql.SENSORS}, p1 AS ({sql.pollution1()}), {more}
    s AS ({sql.side(source, f'{aggregate} AS h', by, sql.letter_index(size))}),
    word AS ({sql.word(['s'], f'coalesce(h, {empty}) AS holds', by, size)})
    SELECT {keys}idx, holds FROM word
    """


def _assertion(df: DataFrame, atom, by=BY, windows: Windows = SIX_HOURS) -> DataFrame:
    return letters(windows, by, rows=(df, [atom])).select(*by, "idx", atom.name)


@query("foreach_element", _assertion_sql("p1", "bool_and(level <> 'Alert')", "true"))
def foreach_element_query(spark, sf_dir):
    return _assertion(hourly_levels(spark, sf_dir), foreach_element("holds", F.col("level") != "Alert"))


@query("foreach_projection", _assertion_sql("sensors", "bool_and(concentration <= 400)", "true"))
def foreach_projection_query(spark, sf_dir):
    atom = foreach_projection("holds", F.col("concentration"), lambda c: c <= 400)
    return _assertion(sensors(spark, sf_dir), atom)


@query("foreach_context", _assertion_sql("sensors", "bool_and(concentration <= 900)", "true", [], HOUR))
def foreach_context_query(spark, sf_dir):
    atom = foreach_context("holds", 900, lambda limit: F.col("concentration") <= limit)
    return _assertion(sensors(spark, sf_dir), atom, [], HOURLY)


@query("exists_element", _assertion_sql("p1", "bool_or(level = 'Alert')", "false"))
def exists_element_query(spark, sf_dir):
    return _assertion(hourly_levels(spark, sf_dir), exists_element("holds", F.col("level") == "Alert"))


@query("exists_projection", _assertion_sql("sensors", "bool_or(concentration > 400)", "false"))
def exists_projection_query(spark, sf_dir):
    atom = exists_projection("holds", F.col("concentration"), lambda c: c > 400)
    return _assertion(sensors(spark, sf_dir), atom)


@query("exists_context", _assertion_sql("sensors", "bool_or(concentration > 900)", "false", [], HOUR))
def exists_context_query(spark, sf_dir):
    atom = exists_context("holds", 900, lambda limit: F.col("concentration") > limit)
    return _assertion(sensors(spark, sf_dir), atom, [], HOURLY)


def errors(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") == "error")
    return e.select(F.col("user_id").alias("sensor_id"), F.unix_millis("ts").alias("tms"))


_ERRORS = "errors AS (SELECT * FROM sensors WHERE event_type = 'error'),"


@query("be_empty", _assertion_sql("errors", "false", "true", more=_ERRORS).replace("false AS h", "bool_and(false) AS h"))
def be_empty_query(spark, sf_dir):
    return _assertion(errors(spark, sf_dir), be_empty("holds"))


@query("be_non_empty", _assertion_sql("errors", "bool_or(true)", "false", more=_ERRORS))
def be_non_empty_query(spark, sf_dir):
    return _assertion(errors(spark, sf_dir), be_non_empty("holds"))


@query(
    "be_subset",
    f"""
    WITH {sql.SENSORS}, p1 AS ({sql.pollution1()}),
    a AS (SELECT DISTINCT {sql.letter_index(HOUR)} AS idx, sensor_id FROM p1 WHERE level = 'Warning'),
    b AS (SELECT DISTINCT {sql.letter_index(HOUR)} AS idx, sensor_id FROM sensors WHERE concentration > 250),
    missing AS (SELECT idx, count(*) AS n FROM a ANTI JOIN b USING (idx, sensor_id) GROUP BY idx),
    s AS ({sql.side('sensors', 'count(*) AS c', [], sql.letter_index(HOUR))}),
    word AS ({sql.word(['s'], '1 AS one', step=HOUR)})
    SELECT idx, n IS NULL AS holds FROM word LEFT JOIN missing USING (idx)
    """,
)
def be_subset_query(spark, sf_dir):
    source = sensors(spark, sf_dir)
    warned = HOURLY.assign(hourly_levels(spark, sf_dir).where(F.col("level") == "Warning"))
    high = HOURLY.assign(source.where(F.col("concentration") > 250))
    word = letters(HOURLY, rows=(source, []))
    missing = missing_per_letter(warned, high, ["sensor_id"])
    return word.join(missing, "idx", "left").select("idx", F.col("n_missing").isNull().alias("holds"))


@query(
    "alerts_broadcast_subset",
    f"""
    WITH {sql.SENSORS}, p1 AS ({sql.pollution1()}),
    alerts AS (SELECT DISTINCT {sql.letter_index(HOUR)} AS idx, sensor_id FROM p1 WHERE level = 'Alert'),
    high AS (SELECT {sql.letter_index(HOUR)} AS idx, sensor_id FROM sensors WHERE concentration > 300),
    flags AS (SELECT idx, bool_and(a.sensor_id IS NOT NULL) AS h FROM high LEFT JOIN alerts a USING (idx, sensor_id) GROUP BY idx),
    word AS ({sql.word(['flags'], 'coalesce(h, true) AS holds', step=HOUR)})
    SELECT idx, holds FROM word
    """,
)
def alerts_broadcast_subset(spark, sf_dir):
    high = sensors(spark, sf_dir).where(F.col("concentration") > 300)
    missing = missing_per_letter(HOURLY.assign(high), HOURLY.assign(alert_rows(spark, sf_dir)), ["sensor_id"])
    word = letters(HOURLY, rows=(high, []))
    return word.join(missing, "idx", "left").select("idx", F.col("n_missing").isNull().alias("holds"))


@query(
    "failing_examples",
    f"""
    WITH {sql.SENSORS}
    SELECT idx, CAST(rank AS INTEGER) AS rank, event_id, concentration FROM (
      SELECT *, row_number() OVER (PARTITION BY idx ORDER BY tms, event_id) AS rank
      FROM (SELECT *, {sql.letter_index()} AS idx FROM sensors) WHERE NOT concentration <= 300) WHERE rank <= 4
    """,
)
def failing_examples_query(spark, sf_dir):
    found = failing_examples(sensors(spark, sf_dir), SIX_HOURS, F.col("concentration") <= 300, ["tms", "event_id"])
    return found.select("idx", "rank", "event_id", "concentration")


@query(
    "window_head",
    f"""
    WITH {sql.SENSORS}
    SELECT idx, n_rows, CAST(rank AS INTEGER) AS rank, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY idx ORDER BY tms, event_id) AS rank, count(*) OVER (PARTITION BY idx) AS n_rows
      FROM (SELECT *, {sql.letter_index()} AS idx FROM sensors)) WHERE rank <= 5
    """,
)
def window_head_query(spark, sf_dir):
    head = window_head(sensors(spark, sf_dir), SIX_HOURS, ["tms", "event_id"])
    return head.select("idx", "n_rows", "rank", "event_id")


# -- order statistics: functions of a whole window that do not merge -------------------------------


@query(
    "window_median",
    f"""
    WITH {sql.SENSORS}
    SELECT w_end, sensor_id, count(*) AS n_rows, median(concentration) AS median
    FROM (SELECT *, {sql.w_end(DAY)} AS w_end FROM sensors) GROUP BY w_end, sensor_id
    """,
)
def window_median_query(spark, sf_dir):
    return window_median(sensors(spark, sf_dir), "concentration", "1 day", by=["sensor_id"]).drop("ts")


@query(
    "letter_percentile",
    f"""
    WITH {sql.SENSORS}
    SELECT idx, count(*) AS n_rows, quantile_disc(concentration, 0.75) AS percentile
    FROM (SELECT *, {sql.letter_index()} AS idx FROM sensors) GROUP BY idx
    """,
)
def letter_percentile_query(spark, sf_dir):
    return letter_percentile(sensors(spark, sf_dir), SIX_HOURS, "concentration", 0.75)


# -- windows with gaps: letters whose only rows lie in the gap after them are empty ----------------

NARROW, APART = 2 * HOUR, 12 * HOUR
HOPPING = Windows(NARROW, APART, T0)
_IN = f"(tms - {T0}) % {APART} < {NARROW}"


def _hopping_sql(aggregate_sql: str, empty: str, value: str = "holds") -> str:
    return f"""
    WITH {sql.SENSORS},
    s AS (SELECT sensor_id, idx, {aggregate_sql} AS h FROM (SELECT *, {sql.letter_index(APART)} AS idx FROM sensors) GROUP BY sensor_id, idx),
    word AS ({sql.word(['s'], f'coalesce(h, {empty}) AS holds', BY, APART)})
    SELECT sensor_id, idx, {value} FROM word
    """


@query("hopping_foreach", _hopping_sql(f"bool_and(concentration <= 300) FILTER ({_IN})", "true"))
def hopping_foreach(spark, sf_dir):
    return _assertion(sensors(spark, sf_dir), foreach_element("holds", F.col("concentration") <= 300), BY, HOPPING)


@query("hopping_exists", _hopping_sql(f"bool_or(concentration > 300) FILTER ({_IN})", "false"))
def hopping_exists(spark, sf_dir):
    return _assertion(sensors(spark, sf_dir), exists_element("holds", F.col("concentration") > 300), BY, HOPPING)


@query(
    "hopping_always",
    _hopping_sql(
        f"bool_and(concentration <= 300) FILTER ({_IN})", "true", f"{sql.verdict(sql.always(sql.bit('holds'), 3, BY))} AS verdict"
    ),
)
def hopping_always(spark, sf_dir):
    word = letters(HOPPING, BY, rows=(sensors(spark, sf_dir), [foreach_element("holds", F.col("concentration") <= 300)]))
    return with_verdict(evaluate(word, always(now("holds"), 3), BY)).select("sensor_id", "idx", "verdict")


@query(
    "always_beyond_100_letters",
    f"""
    WITH {sql.SENSORS}, s AS ({sql.side('sensors', 'max(concentration) AS m', idx=sql.letter_index(HOUR))}),
    word AS ({sql.word(['s'], 'coalesce(m, 0) <= 1900 AS calm', step=HOUR)})
    SELECT idx, {sql.verdict(sql.always(sql.bit('calm'), 150))} AS verdict FROM word
    """,
)
def always_beyond_100_letters(spark, sf_dir):
    """A horizon of 150 hourly letters over the whole word."""
    word = letters(HOURLY, rows=(sensors(spark, sf_dir), [foreach_element("calm", F.col("concentration") <= 1900)]))
    return with_verdict(evaluate(word, always(now("calm"), 150))).select("idx", "verdict")


# -- aggregates of one's own ---------------------------------------------------------------------


@query(
    "atom_mean",
    f"""
    WITH {sql.SENSORS}, s AS ({sql.side('sensors', 'avg(concentration) AS m, max(concentration) - min(concentration) AS w, count(*) AS c', BY)}),
    word AS ({sql.word(['s'], 'm, w, coalesce(c, 0) AS c', BY)})
    SELECT sensor_id, idx, round(m, 4) AS mean, round(w, 4) AS width FROM word
    """,
)
def atom_mean(spark, sf_dir):
    """Mean and width of every letter's values from aggregates that are given here."""
    value = F.col("concentration")
    atoms = [*mean_of("c", value), aggregate("high", value, F.max), aggregate("low", value, F.min)]
    word = letters(SIX_HOURS, BY, rows=(sensors(spark, sf_dir), atoms))
    return word.select("sensor_id", "idx", F.round(mean_value("c"), 4).alias("mean"), F.round(F.col("high") - F.col("low"), 4).alias("width"))


@query(
    "subset_examples",
    f"""
    WITH {sql.SENSORS}, p1 AS ({sql.pollution1()}),
    a AS (SELECT DISTINCT {sql.letter_index()} AS idx, sensor_id FROM sensors WHERE concentration > 300),
    b AS (SELECT DISTINCT {sql.letter_index()} AS idx, sensor_id FROM p1 WHERE level = 'Alert')
    SELECT idx, CAST(rank AS INTEGER) AS rank, sensor_id FROM (
      SELECT idx, sensor_id, row_number() OVER (PARTITION BY idx ORDER BY sensor_id) AS rank
      FROM a ANTI JOIN b USING (idx, sensor_id)) WHERE rank <= 4
    """,
)
def subset_examples_query(spark, sf_dir):
    high = SIX_HOURS.assign(sensors(spark, sf_dir).where(F.col("concentration") > 300))
    return subset_examples(high, SIX_HOURS.assign(alert_rows(spark, sf_dir)), ["sensor_id"]).select("idx", "rank", "sensor_id")
