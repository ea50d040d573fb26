from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tidemark.session import clean_scratch, local_session, scratch_path  # noqa: E402

# Sensor readings "timestamp,sensor_id,concentration" with known results (FIXTURES.md).
SENSOR_LINES = {
    "sensor1": "3100,1,405 3200,2,185 4100,1,210 5100,1,185",
    "sensor2": "2100,4,190 3100,1,505 3200,1,300 4100,2,401 5250,8,478 6100,3,285",
    "sensor3": """
        2100,1,350 2200,2,500 2300,3,401 2400,1,500 2500,2,350 2600,3,401
        3100,1,350 3200,2,500 3300,3,401 3400,1,500 3500,2,350 3600,3,401
        4100,1,350 4200,2,500 4300,3,401 4400,1,500 4500,2,350 4600,3,401 4700,4,185
        5100,1,150 5200,2,500 5300,3,401 5400,1,300 5500,2,350 5600,3,401 5700,4,185
        6100,1,150 6200,2,190 6300,3,401 6400,1,300 6500,2,120 6600,3,401 6700,4,185
    """,
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    clean_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sensor_files(spark):
    """Paths of the sensor readings as text files."""
    paths = {}
    for name, lines in SENSOR_LINES.items():
        paths[name] = scratch_path(spark, name)
        spark.createDataFrame([(line,) for line in lines.split()], "value STRING").write.text(paths[name])
    return paths


@pytest.fixture(scope="session")
def ints(spark):
    """Tables of timed whole numbers: ``ints([1, 2])`` has all rows at time 0."""

    def make(values, tms=0):
        return spark.createDataFrame([(tms, v) for v in values], "tms BIGINT, value INT")

    return make


def rows(df, *columns):
    """Collected rows as a sorted list of tuples."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))
