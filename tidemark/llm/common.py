"""Helpers the operators share: words, sizes, scratch tables, files in the shared folder."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark
from tidemark.session import scratch_path

# White space that separates words everywhere in this subpackage: \x20 and \x09-\x0D.
WHITESPACE = " \t\n\x0b\x0c\r"
MB = 1 << 20
# Rows per Arrow batch: texts may be long, so a batch of Spark's default row count may not fit in memory.
BATCH_ROWS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside nested lambdas.

    A column that a lambda refers to would otherwise be put in place and computed per element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order, as an array; none for NULL or blank texts."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def row_key() -> Column:
    """Key of a document row: rows that agree in id and text are one."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def input_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a frame (file sizes for a scan); no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target_mb: float, at_least: int | None = None) -> int:
    """How many partitions give each about ``target_mb`` of the input, and every core some work.

    Where Spark does not know the size (it then assumes a huge one), texts are measured: one aggregation;
    Parquet takes about half of their bytes. A frame without texts then gets the floor.
    """
    floor = at_least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size >= 1 << 60:
        size = (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 if "text" in df.columns else 0
    return max(floor, math.ceil(size / (target_mb * MB)))


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read back: lineage ends here.

    Used where a result is read several times (iterations) or where tasks have side effects.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; their Python need not have it installed."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(tidemark.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tidemark", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._tidemark_shipped = True


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
