"""Sources, sinks, projections, set operations and event pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import sql
from suite.registry import DAY, HOUR, T0, query
from tidemark.functions.levels import EMERGENCY_ORDER, danger_level, emergency_level, exceeds, level_rank
from tidemark.functions.timed import add_timestamp, field_from_event_time, timed_order
from tidemark.operators.sets import contained, minus, union_marked
from tidemark.operators.windows import Windows
from tidemark.plans import harass, pollution, tips
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.sources.tables import events, fares, incidents, sensors

SIX_HOURS = Windows(6 * HOUR, start_ms=T0)


# -- sources and sinks ---------------------------------------------------------------------------


def _fare_records(spark, sf_dir) -> DataFrame:
    """Purchases as full fare records; half of them without tolls (written as an empty field)."""
    e = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return e.select(
        F.col("event_id").alias("ride_id"),
        F.col("user_id").alias("taxi_id"),
        F.col("user_id").alias("driver_id"),
        F.date_trunc("second", "ts").alias("start_time"),
        F.lit("CSH").alias("payment_type"),
        F.col("value").cast("float").alias("tip"),
        F.when(F.col("value") > 50, F.lit(2.5).cast("float")).alias("tolls"),
        (F.col("value") + 10).cast("float").alias("total_fare"),
    )


@query(
    "src_sensor_scan",
    "SELECT epoch_us(ts) // 1000 AS timestamp, CAST(user_id AS INTEGER) AS sensor_id, value * 4 AS concentration FROM events",
)
def src_sensor_scan(spark, sf_dir):
    path = scratch_path(spark, "sensor-lines")
    files.write_sensors(sensors(spark, sf_dir).withColumnRenamed("tms", "timestamp"), path)
    return files.read_sensors(spark, path).drop("ts")


@query(
    "src_fare_scan",
    """
    SELECT event_id AS ride_id, user_id AS driver_id, epoch_ms(date_trunc('second', ts)) AS tms, 'CSH' AS payment_type,
           CAST(value AS FLOAT) AS tip, CAST(CASE WHEN value > 50 THEN 2.5 ELSE 0 END AS FLOAT) AS tolls,
           CAST(value + 10 AS FLOAT) AS total_fare
    FROM events WHERE event_type = 'purchase'
    """,
)
def src_fare_scan(spark, sf_dir):
    path = scratch_path(spark, "fare-lines")
    files.write_fares(_fare_records(spark, sf_dir), path)
    read = files.event_time(files.read_fares(spark, path))
    return read.select("ride_id", "driver_id", "tms", "payment_type", "tip", "tolls", "total_fare")


@query(
    "sink_fare_csv",
    """
    SELECT concat_ws(',', event_id, user_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'CSH', CAST(value AS FLOAT),
                     CASE WHEN value > 50 THEN '2.5' ELSE '' END, CAST(value + 10 AS FLOAT)) AS value
    FROM events WHERE event_type = 'purchase'
    """,
)
def sink_fare_csv(spark, sf_dir):
    path = scratch_path(spark, "fare-lines")
    files.write_fares(_fare_records(spark, sf_dir), path)
    return spark.read.text(path)


# -- projections, filters, scalar functions ------------------------------------------------------


@query("proj_timed", "SELECT epoch_us(ts) // 1000 AS tms, user_id AS sensor_id, value * 4 AS concentration FROM events")
def proj_timed(spark, sf_dir):
    return sensors(spark, sf_dir).select("tms", "sensor_id", "concentration")


@query("filter_nonneg", "SELECT event_id, value - 50 AS x FROM events WHERE NOT (value - 50 < 0)")
def filter_nonneg(spark, sf_dir):
    shifted = events(spark, sf_dir).select("event_id", (F.col("value") - 50).alias("x"))
    return shifted.where(~(F.col("x") < 0))


@query("add_timestamp", f"WITH {sql.SENSORS} SELECT sensor_id, w_end, tms, level FROM ({sql.pollution1()})")
def add_timestamp_query(spark, sf_dir):
    return add_timestamp(pollution.pollution1(sensors(spark, sf_dir), "1 hour")).drop("ts")


@query(
    "level_emergency",
    f"""
    SELECT event_id, {sql.emergency('value * 4')} AS level,
           CAST(list_position(['Alert', 'Warning', 'Notice', 'OK'], {sql.emergency('value * 4')}) - 1 AS INTEGER) AS lvl_id
    FROM events
    """,
)
def level_emergency(spark, sf_dir):
    level = emergency_level(F.col("concentration"))
    return (
        sensors(spark, sf_dir)
        .select("event_id", level.alias("level"))
        .withColumn("lvl_id", level_rank(F.col("level"), EMERGENCY_ORDER))
    )


@query("level_danger", f"WITH {sql.INCIDENTS} SELECT event_id, {sql.danger('danger')} AS level FROM incidents")
def level_danger(spark, sf_dir):
    return incidents(spark, sf_dir).select("event_id", danger_level(F.col("danger")).alias("level"))


@query(
    "field_from_event_time",
    "SELECT event_id, epoch_us(ts) // 1000 AS tms, epoch_us(ts) // 1000 AS timestamp FROM events",
)
def field_from_event_time_query(spark, sf_dir):
    rows = sensors(spark, sf_dir).select("event_id", "tms", F.lit(0).cast("bigint").alias("timestamp"))
    return field_from_event_time(rows, "timestamp")


@query("timed_order", "SELECT value, epoch_us(ts) // 1000 AS tms, event_id FROM events ORDER BY value, tms, event_id")
def timed_order_query(spark, sf_dir):
    rows = events(spark, sf_dir).select("value", F.unix_millis("ts").alias("tms"), "event_id")
    return timed_order(rows, ["value"])


# -- set operations ------------------------------------------------------------------------------

_ALERT_KEYS = (
    f"alert_keys AS (SELECT DISTINCT {sql.letter_index()} AS idx, sensor_id FROM ({sql.pollution1()}) WHERE level = 'Alert')"
)


def letter_keys(df: DataFrame, *more: str) -> DataFrame:
    return SIX_HOURS.assign(df).select("idx", "sensor_id", *more)


def alert_rows(spark, sf_dir) -> DataFrame:
    levels = add_timestamp(pollution.pollution1(sensors(spark, sf_dir), "1 hour"))
    return levels.where(F.col("level") == "Alert")


@query(
    "minus",
    f"""
    WITH {sql.SENSORS}, {_ALERT_KEYS}
    SELECT idx, sensor_id FROM (SELECT {sql.letter_index()} AS idx, sensor_id FROM sensors) s
    WHERE NOT EXISTS (SELECT 1 FROM alert_keys a
                      WHERE a.idx IS NOT DISTINCT FROM s.idx AND a.sensor_id IS NOT DISTINCT FROM s.sensor_id)
    """,
)
def minus_query(spark, sf_dir):
    return minus(letter_keys(sensors(spark, sf_dir)), letter_keys(alert_rows(spark, sf_dir)))


@query(
    "union_marked",
    f"""
    WITH {sql.SENSORS}, {_ALERT_KEYS}
    SELECT {sql.letter_index()} AS idx, sensor_id, true AS is_left FROM sensors
    UNION ALL SELECT idx, sensor_id, false AS is_left FROM alert_keys
    """,
)
def union_marked_query(spark, sf_dir):
    return union_marked(letter_keys(sensors(spark, sf_dir)), letter_keys(alert_rows(spark, sf_dir)).distinct())


@query(
    "membership",
    f"""
    WITH {sql.SENSORS}, {_ALERT_KEYS}
    SELECT event_id, a.idx IS NOT NULL AS alerted
    FROM (SELECT *, {sql.letter_index()} AS idx FROM sensors) s LEFT JOIN alert_keys a USING (idx, sensor_id)
    """,
)
def membership(spark, sf_dir):
    rows = letter_keys(sensors(spark, sf_dir), "event_id")
    marked = contained(rows, letter_keys(alert_rows(spark, sf_dir)), "alerted", ["idx", "sensor_id"])
    return marked.select("event_id", "alerted")


# -- event pipelines -----------------------------------------------------------------------------


@query("pollution1", f"WITH {sql.SENSORS} SELECT w_end, sensor_id, level FROM ({sql.pollution1()})")
def pollution1(spark, sf_dir):
    return pollution.pollution1(sensors(spark, sf_dir), "1 hour").drop("ts")


@query(
    "pollution1_sliding",
    f"""
    WITH {sql.SENSORS}
    SELECT w_end, sensor_id, {sql.emergency('max(concentration)')} AS level
    FROM (SELECT *, {sql.sliding_ends(3 * HOUR, HOUR)} AS w_end FROM sensors) GROUP BY w_end, sensor_id
    """,
)
def pollution1_sliding(spark, sf_dir):
    return pollution.pollution1(sensors(spark, sf_dir), "3 hours", "1 hour").drop("ts")


_OVER = ", ".join(f"count(*) FILTER (mean > {limit}) AS over{limit}" for limit in (180, 200, 400))
_LEVEL_BY_COUNT = (
    "CASE WHEN over400 >= 3 THEN 'Alert' WHEN over200 >= 3 THEN 'Warning' WHEN over180 >= 3 THEN 'Notice' ELSE 'OK' END"
)

def _pollution2_sql(size: int, slide: int) -> str:
    return f"""
    WITH {sql.SENSORS}, means AS (
      SELECT w_end, sensor_id, avg(concentration) AS mean
      FROM (SELECT *, {sql.sliding_ends(size, slide)} AS w_end FROM sensors) GROUP BY w_end, sensor_id)
    SELECT w_end, {_LEVEL_BY_COUNT} AS level FROM (SELECT w_end, {_OVER} FROM means GROUP BY w_end)
    """


POLLUTION2_SQL = _pollution2_sql(3 * HOUR, HOUR)


@query("pollution2", POLLUTION2_SQL)
def pollution2(spark, sf_dir):
    return pollution.pollution2(sensors(spark, sf_dir), "3 hours", "1 hour").drop("ts")


@query("pollution2_uneven", _pollution2_sql(5 * HOUR, 2 * HOUR))
def pollution2_uneven(spark, sf_dir):
    """The slide is no divisor of the size, so windows do not end at multiples of the slide."""
    return pollution.pollution2(sensors(spark, sf_dir), "5 hours", "2 hours").drop("ts")


@query(
    "sensor_window_mean",
    f"""
    WITH {sql.SENSORS}
    SELECT w_end, sensor_id, round(avg(concentration), 4) AS concentration, max(tms) AS last_tms
    FROM (SELECT *, {sql.w_end(HOUR)} AS w_end FROM sensors) GROUP BY w_end, sensor_id
    """,
)
def sensor_window_mean(spark, sf_dir):
    means = pollution.sensor_window_mean(sensors(spark, sf_dir), "1 hour").drop("ts")
    return means.withColumn("concentration", F.round("concentration", 4))


POLLUTION3_SQL = f"""
    WITH {sql.SENSORS}, slots AS (
      SELECT w_end - 1 AS tms, sensor_id, avg(concentration) AS mean
      FROM (SELECT *, {sql.w_end(DAY)} AS w_end FROM sensors) GROUP BY w_end, sensor_id),
    low AS (
      SELECT w_end, sensor_id, min(mean) AS mean FROM (SELECT *, {sql.sliding_ends(3 * DAY, DAY)} AS w_end FROM slots)
      GROUP BY w_end, sensor_id HAVING count(*) >= 3),
    ends AS (SELECT DISTINCT {sql.sliding_ends(3 * DAY, DAY)} AS w_end FROM slots),
    levels AS (
      SELECT w_end, {_LEVEL_BY_COUNT} AS level FROM (
        SELECT w_end, {_OVER} FROM ends LEFT JOIN low USING (w_end) GROUP BY w_end)),
    limits AS (SELECT *, CASE level WHEN 'Alert' THEN 400 WHEN 'Warning' THEN 200 WHEN 'Notice' THEN 180 END AS lim FROM levels)
    SELECT w_end, level, sensor_id FROM limits JOIN low USING (w_end) WHERE mean > lim
    UNION ALL SELECT w_end, level, CAST(-1 AS BIGINT) AS sensor_id FROM limits WHERE lim IS NULL
    """


def shown_sensors(levels: DataFrame) -> DataFrame:
    """Windows without sensors show -1."""
    return levels.select("w_end", "level", F.coalesce("sensor_id", F.lit(-1).cast("bigint")).alias("sensor_id"))


@query("pollution3", POLLUTION3_SQL)
def pollution3(spark, sf_dir):
    return shown_sensors(pollution.pollution3(sensors(spark, sf_dir), "1 day", "3 days", "1 day"))


@query("harass_max", f"WITH {sql.INCIDENTS} SELECT w_end, zone_id, level FROM ({sql.harass()})")
def harass_max(spark, sf_dir):
    return harass.harass_max(incidents(spark, sf_dir)).drop("ts")


@query(
    "tips_per_hour_driver",
    f"WITH {sql.FARES} SELECT w_end, driver_id, round(tips, 4) AS tips FROM ({sql.driver_tips()})",
)
def tips_per_hour_driver(spark, sf_dir):
    return tips.tips_per_hour_driver(fares(spark, sf_dir)).drop("ts").withColumn("tips", F.round("tips", 4))


@query(
    "max_hourly_tips",
    f"""
    WITH {sql.FARES}
    SELECT w_end, driver_id, tip AS tips FROM (SELECT *, {sql.w_end(HOUR)} AS w_end FROM fares)
    QUALIFY row_number() OVER (PARTITION BY w_end ORDER BY tip DESC, driver_id) = 1
    """,
)
def max_hourly_tips(spark, sf_dir):
    single = fares(spark, sf_dir).select("ts", "driver_id", F.col("tip").alias("tips"))
    return tips.max_hourly_tips(single).drop("ts")


HOURLY_MAX_SQL = f"WITH {sql.FARES} SELECT w_end, driver_id, round(tips, 4) AS tips FROM ({sql.top_tips()})"


@query("hourly_max", HOURLY_MAX_SQL)
def hourly_max(spark, sf_dir):
    return tips.hourly_max(fares(spark, sf_dir)).drop("ts").withColumn("tips", F.round("tips", 4))


__all__ = ["SIX_HOURS", "alert_rows", "exceeds", "letter_keys", "shown_sensors"]
