"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on; all can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_LOCAL_ROOTS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC) and those skewed data depends on (AQE)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this process may use a temporary folder instead,
    one for each application.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = _LOCAL_ROOTS.get(context.applicationId)
    if root is None:
        root = _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared scratch folder."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tidemark/{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared scratch folder.

    Results are read lazily from there, so call it when they have been used, before the session stops.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-distribute rows that are about to be expanded.

    The number of partitions is given explicitly: adaptive execution would judge the few bytes
    before the expansion and merge them into one task.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns)
