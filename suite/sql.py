"""SQL building blocks for the oracles (plain window functions, joins and lists)."""

from __future__ import annotations

from collections.abc import Sequence

from suite.registry import DAY, HOUR, T0

SENSORS = "sensors AS (SELECT event_id, epoch_us(ts) // 1000 AS tms, user_id AS sensor_id, value * 4 AS concentration, event_type FROM events)"
INCIDENTS = "incidents AS (SELECT event_id, epoch_us(ts) // 1000 AS tms, user_id AS zone_id, least(value / 10, 10.0) AS danger FROM events)"
FARES = "fares AS (SELECT event_id, epoch_us(ts) // 1000 AS tms, user_id AS driver_id, value AS tip FROM events WHERE event_type = 'purchase')"


def emergency(c: str) -> str:
    return f"CASE WHEN {c} > 400 THEN 'Alert' WHEN {c} > 200 THEN 'Warning' WHEN {c} > 180 THEN 'Notice' ELSE 'OK' END"


def danger(d: str) -> str:
    return f"CASE WHEN {d} <= 1 THEN 'Safe' WHEN {d} <= 5 THEN 'Warning' WHEN {d} <= 8 THEN 'Danger' ELSE 'Extreme' END"


def w_end(size: int, tms: str = "tms") -> str:
    """End of the epoch-aligned tumbling window."""
    return f"({tms} // {size} + 1) * {size}"


def sliding_ends(size: int, slide: int, tms: str = "tms") -> str:
    """Ends of all epoch-aligned sliding windows with the row in them."""
    return f"unnest(range((({tms} - {size}) // {slide} + 1) * {slide} + {size}, ({tms} // {slide}) * {slide} + {size} + 1, {slide}))"


def cols(names: Sequence[str]) -> str:
    return "".join(f"{n}, " for n in names)


def pollution1(source: str = "sensors", size: int = HOUR, by: Sequence[str] = ()) -> str:
    k = cols(by)
    return (
        f"SELECT {k}sensor_id, w_end, w_end - 1 AS tms, {emergency('max(concentration)')} AS level "
        f"FROM (SELECT *, {w_end(size)} AS w_end FROM {source}) GROUP BY {k}sensor_id, w_end"
    )


def harass(source: str = "incidents", size: int = HOUR, by: Sequence[str] = ()) -> str:
    k = cols(by)
    return (
        f"SELECT {k}zone_id, w_end, w_end - 1 AS tms, {danger('max(danger)')} AS level "
        f"FROM (SELECT *, {w_end(size)} AS w_end FROM {source}) GROUP BY {k}zone_id, w_end"
    )


def driver_tips(source: str = "fares", size: int = HOUR, by: Sequence[str] = ()) -> str:
    k = cols(by)
    return (
        f"SELECT {k}driver_id, w_end, w_end - 1 AS tms, sum(tip) AS tips "
        f"FROM (SELECT *, {w_end(size)} AS w_end FROM {source}) GROUP BY {k}driver_id, w_end"
    )


def top_tips(source: str = "fares", size: int = HOUR, by: Sequence[str] = ()) -> str:
    k = cols(by)
    return (
        f"SELECT {k}w_end, tms, driver_id, tips FROM ({driver_tips(source, size, by)}) "
        f"QUALIFY row_number() OVER (PARTITION BY {k}w_end ORDER BY tips DESC, driver_id) = 1"
    )


def letter_index(size: int = 6 * HOUR, start: int = T0, tms: str = "tms") -> str:
    return f"({tms} - {start}) // {size}"


def slide_indexes(size: int, slide: int, start: int = T0, tms: str = "tms") -> str:
    off = f"({tms} - {start})"
    return f"unnest(range(greatest(0, ({off} - {size} + {slide}) // {slide}), {off} // {slide} + 1))"


def side(source: str, atoms: str, by: Sequence[str] = (), idx: str | None = None) -> str:
    """Letters with rows of one stream: ``by, idx, atoms``."""
    k = cols(by)
    return (
        f"SELECT {k}idx, {atoms} FROM (SELECT *, {idx or letter_index()} AS idx FROM {source}) GROUP BY {k}idx"
    )


def word(
    sides: Sequence[str], values: str, by: Sequence[str] = (), step: int = 6 * HOUR, start: int = T0, cap: int | None = None
) -> str:
    """Dense letters from sparse sides (names of CTEs with ``by, idx``): the word ends with the
    shorter side; ``values`` are the columns with their values at empty letters."""
    k = cols(by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    lasts = " UNION ALL ".join(f"SELECT {k}max(idx) AS last_idx FROM {s}{group}" for s in sides)
    last = "min(last_idx)" if cap is None else f"least(min(last_idx), {cap - 1})"
    ends = f"SELECT {k}{last} AS last_idx FROM ({lasts}){group} HAVING count(last_idx) = {len(sides)}"
    joins = " ".join(f"LEFT JOIN {s} USING ({cols(by)}idx)" for s in sides)
    return (
        f"SELECT {k}idx, {start} + idx * {step} AS w_start, last_idx, {values} FROM "
        f"(SELECT {k}last_idx, unnest(range(0, last_idx + 1)) AS idx FROM ({ends})) {joins}"
    )


# -- three-valued formulas: -1 False, 0 Undecided, 1 True ---------------------------------------


def bit(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE -1 END"


def _frame(n: int, by: Sequence[str]) -> str:
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"OVER ({part}ORDER BY idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


def always(v: str, n: int, by: Sequence[str] = ()) -> str:
    f = _frame(n, by)
    return f"least(min({v}) {f}, CASE WHEN count(*) {f} < {n} THEN 0 ELSE 1 END)"


def eventually(v: str, n: int, by: Sequence[str] = ()) -> str:
    f = _frame(n, by)
    return f"greatest(max({v}) {f}, CASE WHEN count(*) {f} < {n} THEN 0 ELSE -1 END)"


def until(a: str, b: str, n: int, by: Sequence[str] = ()) -> str:
    """Two-valued a and b (conditions)."""
    f = _frame(n, by)
    jb = f"min(CASE WHEN {b} THEN idx END) {f}"
    ka = f"min(CASE WHEN NOT ({a}) THEN idx END) {f}"
    return (
        f"CASE WHEN {jb} IS NOT NULL AND ({ka} IS NULL OR {ka} >= {jb}) THEN 1 "
        f"WHEN {ka} IS NOT NULL OR count(*) {f} = {n} THEN -1 ELSE 0 END"
    )


def verdict(v: str) -> str:
    return f"CASE {v} WHEN 1 THEN 'True' WHEN -1 THEN 'False' ELSE 'Undecided' END"


def bound(letters: str, early: str, late: str, key: str, offsets: Sequence[int], by: Sequence[str] = ()) -> str:
    """``letters`` with ``bound_<o>``: keys of ``early`` at idx all among those of ``late`` at idx + o.
    ``early`` and ``late`` are relations with ``by, idx, key``."""
    k = cols(by)
    joins, values = [], []
    for o in offsets:
        missing = (
            f"SELECT DISTINCT {k}idx, true AS miss_{o} FROM (SELECT DISTINCT {k}idx, {key} FROM {early}) "
            f"ANTI JOIN (SELECT {k}idx - {o} AS idx, {key} FROM {late}) USING ({k}idx, {key})"
        )
        joins.append(f"LEFT JOIN ({missing}) USING ({k}idx)")
        values.append(f"CASE WHEN idx + {o} > last_idx THEN 0 WHEN miss_{o} THEN -1 ELSE 1 END AS bound_{o}")
    return f"SELECT l.*, {', '.join(values)} FROM {letters} l {' '.join(joins)}"


# -- synthetic events ----------------------------------------------------------------------------


def mix(x: str) -> str:
    for i, (a, b, m) in enumerate(
        ((48271, 12345, 2147483647), (40692, 104729, 2147483587), (69621, 7919, 2147483629))
    ):
        x = f"((({x}) * {a} + {b}) % {m})"
        if i == 0:
            x = f"[xor(a, a >> 15) FOR a IN [{x}]][1]"
    return x


def tenths(h: str, low: float, high: float) -> str:
    lo, hi = round(low * 10), round(high * 10)
    return f"({lo} + ({h}) % {hi - lo + 1}) / 10.0"


CASES = "cases AS (SELECT DISTINCT user_id AS case_id FROM events)"


def always_windows(n: int, seed: int = 0) -> str:
    return (
        f"SELECT case_id, idx, {mix(mix(f'case_id + {seed}') + ' + idx')} AS wh "
        f"FROM (SELECT case_id, unnest(range(0, {n})) AS idx FROM cases)"
    )


def eventually_window(n: int, seed: int = 0) -> str:
    return (
        f"SELECT case_id, idx, {mix(mix(f'case_id + {seed}') + ' + idx')} AS wh "
        f"FROM (SELECT case_id, ({mix(f'case_id + {seed}')}) % {n} AS idx FROM cases)"
    )


def until_windows(n: int, seed: int = 0) -> str:
    return (
        f"SELECT case_id, idx, idx = p AS released, {mix(mix(f'case_id + {seed}') + ' + idx')} AS wh "
        f"FROM (SELECT case_id, p, unnest(range(0, p + 1)) AS idx FROM "
        f"(SELECT case_id, ({mix(f'case_id + {seed}')}) % {n} AS p FROM cases))"
    )


def rows(windows: str, n: int, m: int, more: str = "") -> str:
    return (
        f"SELECT case_id, idx, {more}row, {mix('wh + row')} AS h FROM "
        f"(SELECT *, unnest(range(1, {n} + wh % {m - n + 1} + 1)) AS row FROM ({windows}))"
    )


def placed(rows_sql: str, size: int, payload: str = "") -> str:
    extra = f", {payload}" if payload else ""
    return f"SELECT *, idx * {size} + ({mix('h + 1')}) % {size} AS tms{extra} FROM ({rows_sql})"
