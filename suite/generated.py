"""Synthetic windowed events (one test case per sensor of the events table) and the properties
checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import sql
from suite.registry import HOUR, query
from suite.sql import CASES
from tidemark.functions.mixing import mix, pick_int, pick_tenths
from tidemark.operators import generators as g
from tidemark.operators.windows import Windows
from tidemark.plans import properties
from tidemark.sources.tables import events

QUARTER = HOUR // 4


def cases(spark, sf_dir) -> DataFrame:
    return g.cases_from(events(spark, sf_dir), "user_id")


# -- generators ----------------------------------------------------------------------------------


@query("gen_always", f"WITH {CASES} SELECT case_id, idx, wh FROM ({sql.always_windows(5)})")
def gen_always(spark, sf_dir):
    return g.always_windows(cases(spark, sf_dir), 5)


@query("gen_of_n_to_m", f"WITH {CASES} SELECT case_id, idx, row, h FROM ({sql.rows(sql.always_windows(5), 3, 9)})")
def gen_of_n_to_m(spark, sf_dir):
    return g.rows_n_to_m(g.always_windows(cases(spark, sf_dir), 5), 3, 9)


@query("gen_of_n", f"WITH {CASES} SELECT case_id, idx, row, h FROM ({sql.rows(sql.always_windows(5), 4, 4)})")
def gen_of_n(spark, sf_dir):
    return g.rows_n(g.always_windows(cases(spark, sf_dir), 5), 4)


@query(
    "gen_tumbling",
    f"WITH {CASES} SELECT case_id, idx, row, tms FROM ({sql.placed(sql.rows(sql.always_windows(5), 3, 9), QUARTER)})",
)
def gen_tumbling(spark, sf_dir):
    rows = g.rows_n_to_m(g.always_windows(cases(spark, sf_dir), 5), 3, 9)
    return g.place_tumbling(rows, Windows(QUARTER)).select("case_id", "idx", "row", "tms")


@query("gen_eventually", f"WITH {CASES} SELECT case_id, idx, row, h FROM ({sql.rows(sql.eventually_window(6), 1, 3)})")
def gen_eventually(spark, sf_dir):
    return g.rows_n_to_m(g.eventually_window(cases(spark, sf_dir), 6), 1, 3)


@query(
    "gen_later",
    f"WITH {CASES} SELECT case_id, idx + 4 AS idx, row, h FROM ({sql.rows(sql.always_windows(2), 1, 3)})",
)
def gen_later(spark, sf_dir):
    return g.later(g.rows_n_to_m(g.always_windows(cases(spark, sf_dir), 2), 1, 3), 4)


@query(
    "gen_until",
    f"WITH {CASES} SELECT case_id, idx, released, row, h FROM ({sql.rows(sql.until_windows(6), 2, 2, 'released, ')})",
)
def gen_until(spark, sf_dir):
    return g.rows_n(g.until_windows(cases(spark, sf_dir), 6), 2)


@query(
    "gen_concat",
    f"""
    WITH {CASES} SELECT case_id, idx, row, h FROM ({sql.rows(sql.eventually_window(3), 1, 1)})
    UNION ALL SELECT case_id, idx + 3 AS idx, row, h FROM ({sql.rows(sql.always_windows(2, 7), 1, 4)})
    """,
)
def gen_concat(spark, sf_dir):
    c = cases(spark, sf_dir)
    first = g.rows_n(g.eventually_window(c, 3), 1)
    return g.concat(first, g.rows_n_to_m(g.always_windows(c, 2, seed=7), 1, 4), 3)


@query(
    "gen_concat_variable",
    f"""
    WITH {CASES}, f AS ({sql.until_windows(6)}), n AS (SELECT case_id, max(idx) + 1 AS n FROM f GROUP BY case_id)
    SELECT case_id, idx, row, h FROM ({sql.rows('SELECT case_id, idx, wh FROM f', 2, 2)})
    UNION ALL SELECT case_id, idx + n AS idx, row, h FROM ({sql.rows(sql.always_windows(2, 7), 1, 4)}) JOIN n USING (case_id)
    """,
)
def gen_concat_variable(spark, sf_dir):
    """A second part after a first whose length depends on the case."""
    c = cases(spark, sf_dir)
    windows = g.until_windows(c, 6)
    second = g.rows_n_to_m(g.always_windows(c, 2, seed=7), 1, 4)
    return g.concat_after(g.rows_n(windows, 2).drop("released"), g.window_counts(windows), second)


@query(
    "gen_merge",
    f"""
    WITH {CASES} SELECT case_id, idx, row, h FROM ({sql.rows(sql.always_windows(3), 5, 5)})
    UNION ALL SELECT case_id, idx, row + 5 AS row, h FROM ({sql.rows(sql.always_windows(3, 7), 2, 2)})
    """,
)
def gen_merge(spark, sf_dir):
    c = cases(spark, sf_dir)
    five, two = g.rows_n(g.always_windows(c, 3), 5), g.rows_n(g.always_windows(c, 3, seed=7), 2)
    return g.merge(five, two, 5)


@query(
    "gen_values",
    f"""
    WITH {CASES}
    SELECT case_id, idx, row, ({sql.mix('h + 2')}) % 30 AS sensor_id, {sql.tenths(sql.mix('h + 3'), 180.1, 1000)} AS concentration
    FROM ({sql.rows(sql.always_windows(5), 3, 9)})
    """,
)
def gen_values(spark, sf_dir):
    rows = g.rows_n_to_m(g.always_windows(cases(spark, sf_dir), 5), 3, 9)
    return rows.select(
        "case_id",
        "idx",
        "row",
        pick_int(mix(F.col("h") + F.lit(2)), 0, 29).alias("sensor_id"),
        pick_tenths(mix(F.col("h") + F.lit(3)), 180.1, 1000.0).alias("concentration"),
    )


# -- properties ----------------------------------------------------------------------------------

CASE = ["case_id"]
SECOND, MINUTE = 1000, 60_000


def property_sql(
    source: str, output: str, input_atoms: str, output_atoms: str, values: str, formula: str, size: int, slide: int | None = None,
    more: str = "", letters: str = "word", start: int = 0, cases_sql: str = CASES, generated: bool = True,
) -> str:
    """Verdict per case: generated source, output of the pipeline, letters, formula at letter 0."""
    idx = sql.letter_index(size, start) if slide is None else sql.slide_indexes(size, slide, start)
    step = slide or size
    return f"""
    WITH {cases_sql}, src AS (SELECT *{" EXCLUDE (idx)" if generated else ""} FROM ({source})), out AS ({output}),
    i AS ({sql.side('src', input_atoms, CASE, idx)}), o AS ({sql.side('out', output_atoms, CASE, idx)}),
    word AS ({sql.word(['i', 'o'], values, CASE, step, start)}){more},
    f AS (SELECT case_id, idx, {formula} AS v FROM {letters})
    SELECT case_id, {sql.verdict('coalesce(v, 0)')} AS verdict, coalesce(v, 0) >= 0 AS passed
    FROM cases LEFT JOIN (SELECT * FROM f WHERE idx = 0) USING (case_id)
    """


def _ints(windows: int = 10) -> str:
    rows = sql.rows(sql.always_windows(windows), 10, 50)
    return sql.placed(rows, 50, f"({sql.mix('h + 2')}) * 2 - 2147483629 AS value")


def _sensors(windows: int, n: int, m: int, sensors: int, low: float, high: float) -> str:
    rows = sql.rows(sql.always_windows(windows), n, m)
    return sql.placed(
        rows,
        SECOND,
        f"({sql.mix('h + 2')}) % {sensors} AS sensor_id, {sql.tenths(sql.mix('h + 3'), low, high)} AS concentration",
    )


def _incidents(size: int, windows: int, n: int, m: int, low: float, high: float) -> str:
    rows = sql.rows(sql.always_windows(windows), n, m)
    return sql.placed(
        rows, size, f"({sql.mix('h + 2')}) % 10 AS zone_id, {sql.tenths(sql.mix('h + 3'), low, high)} AS danger"
    )


_ANY_FARE = f"{sql.mix('h + 2')} AS driver_id, {sql.tenths(sql.mix('h + 3'), 0.1, 100.0)} AS tip"
N = "count(*) AS n"


def register(name: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark, sf_dir, fn=properties.PROPERTIES[name]):
        return fn(cases(spark, sf_dir))


register(
    "prop_filter_nonneg",
    property_sql(
        _ints(),
        "SELECT * FROM src WHERE NOT (value < 0)",
        N,
        "bool_and(value >= 0) AS nn",
        "coalesce(nn, true) AS nn",
        sql.always(f"least({sql.bit('nn')}, {sql.bit('missing IS NULL')})", 5, CASE),
        100,
        more=""", absent AS (
          SELECT case_id, tms // 100 AS idx, count(*) AS missing FROM out o
          WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.case_id = o.case_id AND s.tms = o.tms AND s.value = o.value)
          GROUP BY case_id, tms // 100),
        related AS (SELECT * FROM word LEFT JOIN absent USING (case_id, idx))""",
        letters="related",
    ),
)

_NEXT = "(SELECT *, lead(w_start) OVER (PARTITION BY case_id ORDER BY idx) AS nxt FROM word)"


def _bind(condition: str) -> str:
    return f"(SELECT *, CASE WHEN nxt IS NULL THEN 0 WHEN {condition} THEN 1 ELSE -1 END AS b FROM {_NEXT})"


register(
    "prop_time_monotone",
    property_sql(
        _ints(), "SELECT * FROM src", N, N, "1 AS one", sql.always("b", 4, CASE), 100, letters=_bind("w_start <= nxt")
    ),
)
register(
    "prop_slide_step",
    property_sql(
        _ints(), "SELECT * FROM src", N, N, "1 AS one", sql.always("b", 4, CASE), 100, 50, letters=_bind("nxt - w_start = 50")
    ),
)
register(
    "prop_event_time_field",
    property_sql(
        f"SELECT *, tms AS timestamp FROM ({_ints(4)})",
        "SELECT * FROM src",
        N,
        "bool_and(timestamp = tms) AS same",
        "coalesce(same, true) AS same",
        sql.always(sql.bit("same"), 2, CASE),
        100,
    ),
)
register(
    "prop_high_never_ok",
    property_sql(
        _sensors(5, 10, 50, 10, 180.1, 1000.0),
        sql.pollution1("src", SECOND, CASE),
        N,
        "bool_and(level <> 'OK') AS ok",
        "coalesce(ok, true) AS ok",
        sql.always(sql.bit("ok"), 5, CASE),
        SECOND,
    ),
)


def _any_bound(offsets: int) -> str:
    return f"greatest({', '.join(f'bound_{o}' for o in range(offsets))})"


register(
    "prop_high_eventually_alert",
    property_sql(
        _sensors(5, 5, 10, 30, 500.0, 1000.0),
        sql.pollution1("src", SECOND, CASE),
        N,
        N,
        "1 AS one",
        sql.always(_any_bound(5), 10, CASE),
        SECOND // 4,
        more=f""",
        early AS (SELECT case_id, tms // 250 AS idx, sensor_id FROM src WHERE concentration > 400),
        late AS (SELECT case_id, tms // 250 AS idx, sensor_id FROM out WHERE level = 'Alert'),
        b AS ({sql.bound('word', 'early', 'late', 'sensor_id', range(5), CASE)})""",
        letters="b",
    ),
)


def _never_safe(source: str) -> str:
    return property_sql(
        source,
        sql.harass("src", HOUR, CASE),
        N,
        "bool_and(level <> 'Safe') AS ns",
        "coalesce(ns, true) AS ns",
        sql.always(sql.bit("ns"), 20, CASE),
        HOUR,
    )


register("prop_danger_never_safe", _never_safe(_incidents(HOUR, 20, 15, 50, 1.1, 10.0)))
register("prop_danger_never_safe_fails", _never_safe(_incidents(HOUR, 20, 2, 5, 0.5, 10.0)))
register(
    "prop_extreme_eventually_flagged",
    property_sql(
        _incidents(30 * MINUTE, 2, 50, 50, 0.0, 10.0),
        sql.harass("src", HOUR, CASE),
        "count(*) FILTER (danger > 8) AS nx",
        N,
        "coalesce(nx, 0) AS nx",
        f"greatest(-({sql.bit('nx > 0')}), {_any_bound(4)})",
        15 * MINUTE,
        more=f""",
        early AS (SELECT case_id, tms // {15 * MINUTE} AS idx, zone_id FROM src WHERE danger > 8),
        late AS (SELECT case_id, tms // {15 * MINUTE} AS idx, zone_id FROM out WHERE level = 'Extreme'),
        b AS ({sql.bound('word', 'early', 'late', 'zone_id', range(4), CASE)})""",
        letters="b",
    ),
)
register(
    "prop_one_driver_one_tip",
    property_sql(
        f"""
        SELECT case_id, idx, row, h, tms, CASE WHEN once THEN 42 ELSE driver_id END AS driver_id, tip FROM (
          {sql.placed(
              f"SELECT *, true AS once FROM ({sql.rows(sql.eventually_window(3), 1, 1)}) UNION ALL "
              f"SELECT case_id, idx + 7 AS idx, row, h, false AS once FROM ({sql.rows(sql.always_windows(1, 7), 1, 10)})",
              15 * MINUTE,
              _ANY_FARE,
          )})
        """,
        sql.top_tips("src", HOUR, CASE),
        N,
        "count(*) AS n, bool_and(driver_id = 42) AS is42",
        "coalesce(o.n, 0) AS n, coalesce(is42, true) AS is42",
        sql.eventually(sql.bit("n = 1 AND is42"), 4, CASE),
        15 * MINUTE,
    ),
)
register(
    "prop_tips_summed_by_hour",
    property_sql(
        sql.placed(sql.rows(sql.always_windows(25), 10, 10), HOUR // 6, "row AS driver_id, row * 10.0 AS tip"),
        sql.driver_tips("src", HOUR, CASE),
        N,
        "bool_and(tips = driver_id * 60) AS good",
        "coalesce(good, true) AS good",
        sql.always(sql.bit("good"), 4, CASE),
        HOUR,
    ),
)
register(
    "prop_single_hourly_max",
    property_sql(
        sql.placed(sql.rows(sql.always_windows(60), 1, 50), HOUR // 12, _ANY_FARE),
        sql.top_tips("src", HOUR, CASE),
        "count(*) AS ni",
        N,
        "coalesce(n, 0) AS n",
        sql.always(sql.bit("n = 1"), 5, CASE),
        HOUR,
    ),
)
register(
    "prop_driver_until_driver",
    property_sql(
        sql.placed(
            f"SELECT *, CASE WHEN released THEN 2 ELSE 1 END AS driver_id FROM ({sql.rows(sql.until_windows(6), 5, 5, 'released, ')}) "
            f"UNION ALL SELECT *, CASE WHEN released THEN 1 ELSE 2 END FROM ({sql.rows(sql.until_windows(6), 2, 2, 'released, ')})",
            HOUR,
            "2.5 AS tip",
        ),
        sql.top_tips("src", HOUR, CASE),
        N,
        "bool_and(driver_id = 1) AS d1, bool_and(driver_id = 2) AS d2",
        "coalesce(d1, true) AS d1, coalesce(d2, true) AS d2",
        sql.until("d1", "d2", 6, CASE),
        HOUR,
    ),
)
