"""Properties on recorded tables: every user, driver or customer is a case, and verdicts vary."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import sql
from suite.generated import CASE, N, property_sql
from suite.registry import DAY, HOUR, T0, query
from tidemark.operators.atoms import exists_element, foreach_element
from tidemark.operators.temporal import always, eventually, now, until
from tidemark.operators.windows import Windows
from tidemark.plans.harass import harass_max
from tidemark.plans.pollution import pollution1
from tidemark.plans.property import Property, for_all_cases
from tidemark.plans.tips import hourly_max, tips_per_hour_driver
from tidemark.sources.tables import fares, incidents, sensors

ORDERS_START = 694_224_000_000  # 1992-01-01 UTC, where the orders begin
NAMES: list[str] = []


def _register(name: str, oracle: str):
    NAMES.append(name)
    return query(name, oracle)


def _by_user(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("case_id", F.col(key))


def _source(table: str, key: str) -> str:
    cte = {"sensors": sql.SENSORS, "incidents": sql.INCIDENTS, "fares": sql.FARES}[table]
    return f"WITH {cte} SELECT *, {key} AS case_id FROM {table}"


def _check(prop: Property, source: DataFrame, subject) -> DataFrame:
    return for_all_cases(prop, source, subject, source.select("case_id").distinct(), record=False)


@_register(
    "recorded_high_never_ok",
    property_sql(
        _source("sensors", "sensor_id"), sql.pollution1("src", HOUR, CASE), N, "bool_and(level <> 'OK') AS ok",
        "coalesce(ok, true) AS ok", sql.always(sql.bit("ok"), 3, CASE), 12 * HOUR, start=T0, generated=False,
    ),
)
def recorded_high_never_ok(spark, sf_dir):
    """No hourly level is OK during three half days."""
    prop = Property(
        Windows(12 * HOUR, start_ms=T0), always(now("not_ok"), 3), output_atoms=[foreach_element("not_ok", F.col("level") != "OK")]
    )
    return _check(prop, _by_user(sensors(spark, sf_dir), "sensor_id"), partial(pollution1, size="1 hour", keys=CASE))


@_register(
    "recorded_danger_never_safe",
    property_sql(
        _source("incidents", "zone_id"), sql.harass("src", HOUR, CASE), N, "bool_and(level <> 'Safe') AS ns",
        "coalesce(ns, true) AS ns", sql.always(sql.bit("ns"), 4, CASE), DAY, start=T0, generated=False,
    ),
)
def recorded_danger_never_safe(spark, sf_dir):
    """No hour of a zone is Safe during four days."""
    prop = Property(
        Windows(DAY, start_ms=T0), always(now("not_safe"), 4), output_atoms=[foreach_element("not_safe", F.col("level") != "Safe")]
    )
    return _check(prop, _by_user(incidents(spark, sf_dir), "zone_id"), partial(harass_max, keys=CASE))


@_register(
    "recorded_single_hourly_max",
    property_sql(
        _source("fares", "driver_id"), sql.top_tips("src", HOUR, CASE), N, N,
        "coalesce(o.n, 0) AS n", sql.eventually(sql.bit("n >= 2"), 4, CASE), DAY, start=T0, generated=False,
        cases_sql=f"{sql.FARES}, cases AS (SELECT DISTINCT driver_id AS case_id FROM fares)",
    ),
)
def recorded_single_hourly_max(spark, sf_dir):
    """Some day of the first four has fares in two hours or more."""
    prop = Property(Windows(DAY, start_ms=T0), eventually(now(F.col("n_output") >= 2), 4))
    return _check(prop, _by_user(fares(spark, sf_dir), "driver_id"), lambda df: hourly_max(df, keys=CASE))


@_register(
    "recorded_tips_bounded",
    property_sql(
        _source("fares", "driver_id"), sql.driver_tips("src", HOUR, CASE), N, "bool_and(tips <= 120) AS good",
        "coalesce(good, true) AS good", sql.always(sql.bit("good"), 5, CASE), DAY, start=T0, generated=False,
        cases_sql=f"{sql.FARES}, cases AS (SELECT DISTINCT driver_id AS case_id FROM fares)",
    ),
)
def recorded_tips_bounded(spark, sf_dir):
    """No hour's tips of a driver are over 120 during five days."""
    prop = Property(
        Windows(DAY, start_ms=T0), always(now("bounded"), 5), output_atoms=[foreach_element("bounded", F.col("tips") <= 120)]
    )
    return _check(prop, _by_user(fares(spark, sf_dir), "driver_id"), partial(tips_per_hour_driver, keys=CASE))


@_register(
    "recorded_quiet_until_alert",
    property_sql(
        _source("sensors", "sensor_id"), sql.pollution1("src", HOUR, CASE), N,
        "bool_and(level <> 'Warning') AS quiet, bool_or(level = 'Alert') AS alert",
        "coalesce(quiet, true) AS quiet, coalesce(alert, false) AS alert", sql.until("quiet", "alert", 6, CASE), 12 * HOUR, start=T0, generated=False,
    ),
)
def recorded_quiet_until_alert(spark, sf_dir):
    """No Warning before the first Alert, which comes within six half days."""
    prop = Property(
        Windows(12 * HOUR, start_ms=T0),
        until(now("quiet"), now("alert"), 6),
        output_atoms=[foreach_element("quiet", F.col("level") != "Warning"), exists_element("alert", F.col("level") == "Alert")],
    )
    return _check(prop, _by_user(sensors(spark, sf_dir), "sensor_id"), partial(pollution1, size="1 hour", keys=CASE))


@_register(
    "recorded_orders_bounded",
    property_sql(
        "SELECT o_custkey AS case_id, epoch_us(o_orderdate) // 1000 AS tms, o_totalprice AS price FROM orders",
        "SELECT * FROM src", N, "bool_and(price < 300000) AS good", "coalesce(good, true) AS good",
        sql.always(sql.bit("good"), 8, CASE), 180 * DAY, start=ORDERS_START, generated=False,
        cases_sql="cases AS (SELECT DISTINCT o_custkey AS case_id FROM orders)",
    ),
)
def recorded_orders_bounded(spark, sf_dir):
    """A customer has no order of 300,000 or more during eight half years."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    source = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("price"))
    source = source.withColumn("tms", F.unix_millis("ts"))
    prop = Property(
        Windows(180 * DAY, start_ms=ORDERS_START), always(now("bounded"), 8), output_atoms=[foreach_element("bounded", F.col("price") < 300_000)]
    )
    return _check(prop, source, lambda df: df)
