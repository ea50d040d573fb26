"""Level mappings (JVM-side ``when`` chains)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Emergency limits by level, highest first, and the number of sensors that
# must exceed a limit for a global level.
EMERGENCY_LIMITS = (("Alert", 400.0), ("Warning", 200.0), ("Notice", 180.0))
EMERGENCY_ORDER = ("Alert", "Warning", "Notice", "OK")
MIN_SENSORS = 3
# Danger limits, lowest first (inclusive upper bounds).
DANGER_BOUNDS = (("Safe", 1.0), ("Warning", 5.0), ("Danger", 8.0))
DANGER_ORDER = ("Safe", "Warning", "Danger", "Extreme")


def exceeds(value: Column, limit: float) -> Column:
    """``value > limit``, false for NaN (Spark orders NaN above every number) and for NULL."""
    return F.coalesce((value > F.lit(limit)) & ~F.isnan(value), F.lit(False))


def _first_of(cases: list[tuple[Column, str]], default: str) -> Column:
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in cases], F.lit(default))


def emergency_level(concentration: Column) -> Column:
    """Alert above 400, Warning above 200, Notice above 180, otherwise OK (also for NaN)."""
    return _first_of([(exceeds(concentration, limit), name) for name, limit in EMERGENCY_LIMITS], "OK")


def danger_level(danger: Column) -> Column:
    """Safe up to 1, Warning up to 5, Danger up to 8, otherwise Extreme (also for NaN)."""
    return _first_of([(danger <= F.lit(bound), name) for name, bound in DANGER_BOUNDS], "Extreme")


def level_by_counts(counts: dict[str, Column]) -> Column:
    """The highest emergency level whose limit is exceeded by enough sensors."""
    return _first_of([(counts[name] >= MIN_SENSORS, name) for name, _ in EMERGENCY_LIMITS], "OK")


def level_rank(level: Column, order: tuple[str, ...]) -> Column:
    """Position of a level in its enumeration, for ordering."""
    return (F.array_position(F.array(*[F.lit(x) for x in order]), level) - 1).cast("int")
