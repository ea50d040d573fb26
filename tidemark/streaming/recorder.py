"""Run a pipeline as a stream over a bounded input and record what it emits.

A stream ends when its input does, but its last windows only close once the watermark passes them.
``record_stream`` therefore runs the query twice from one checkpoint: first over the input, then
over a single end marker with a far-future event time that it adds to a second, so far empty,
source of the same query. The marker's own window stays open and never shows.

The marker has an event time and nothing else. Filters of the pipeline may drop it, but only after it
has moved the watermark; and if a pipeline with state still ends with a lower watermark, the run fails
instead of being incomplete.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import scratch_path
from tidemark.sources.recordings import read_recorded, record_table

END_OF_TIME = datetime(9000, 1, 1)
# A timer at this time fires at the end of a bounded input only.
END_OF_INPUT_MS = int(datetime(8999, 1, 1, tzinfo=timezone.utc).timestamp()) * 1000


def ascending(stream: DataFrame, delay: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """Watermark for an input whose files arrive in time order: the largest event time so far,
    minus a delay when they may be out of order by that much."""
    return stream.withWatermark(ts, delay)


def read_as_stream(recorded: DataFrame, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A recorded table as a file stream. By default all files are one micro-batch, so that their
    order does not matter; with fewer per trigger they must be in time order."""
    reader = recorded.sparkSession.readStream.schema(recorded.schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


def replay(df: DataFrame, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A finite timed table as a stream: written once as parquet, read back as a file stream."""
    path = scratch_path(df.sparkSession, name)
    return read_as_stream(record_table(df, path), path, files_per_trigger)


def _end_marker(spark: SparkSession, schema: T.StructType, ts: str) -> DataFrame:
    columns = [
        (F.lit(END_OF_TIME) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return spark.range(1).select(*columns)


def _tied_to_event_time(stream: DataFrame, ts: str) -> DataFrame:
    """The same rows, with every column an expression of the event time too.

    Spark moves filters below a watermark unless they refer to its column; now they all do. So the
    filters of a pipeline see the end marker only after it has moved the watermark.
    """
    present = F.col(ts).isNotNull()
    return stream.select(*[c if c == ts else F.when(present, F.col(c)).alias(c) for c in stream.columns])


def _assert_flushed(query: StreamingQuery) -> None:
    """The watermark of a query with state must have reached the end marker."""
    progress = query.lastProgress
    if progress is None or not progress["stateOperators"]:
        return
    reached = progress.get("eventTime", {}).get("watermark", "")
    if not reached.startswith(str(END_OF_TIME.year)):
        raise RuntimeError(f"the stream was not flushed: its watermark ended at {reached or 'none'}")


def store_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available and write it as parquet, exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_to_end(
    source: DataFrame,
    subject: Callable[[DataFrame], DataFrame],
    root: str,
    store: Callable[[DataFrame, str], StreamingQuery],
    delay: str = "0 seconds",
    flush: bool = True,
    ts: str = "ts",
) -> None:
    """Run ``subject`` over the stream ``source`` to its end; ``store(stream, checkpoint)`` processes
    everything available of a stream."""
    spark = source.sparkSession
    checkpoint = f"{root}/checkpoint"
    if not flush:
        store(subject(ascending(source, delay, ts)), checkpoint)
        return
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in source.schema.fields])
    spark.createDataFrame([], schema).write.parquet(f"{root}/end")
    end = spark.readStream.schema(schema).parquet(f"{root}/end")
    result = subject(_tied_to_event_time(ascending(source.unionByName(end), delay, ts), ts))
    store(result, checkpoint)
    _end_marker(spark, schema, ts).write.mode("append").parquet(f"{root}/end")
    _assert_flushed(store(result, checkpoint))


def record_stream(
    source: DataFrame,
    subject: Callable[[DataFrame], DataFrame],
    name: str,
    delay: str = "0 seconds",
    flush: bool = True,
    ts: str = "ts",
) -> DataFrame:
    """Run ``subject`` over the stream ``source`` to its end and read the recorded output back.

    ``flush=False`` leaves the windows open that the watermark has not passed; use it for subjects
    without state.
    """
    root = scratch_path(source.sparkSession, name)
    out = f"{root}/out"
    run_to_end(source, subject, root, lambda stream, checkpoint: store_stream(stream, out, checkpoint), delay, flush, ts)
    recorded = read_recorded(source.sparkSession, out)
    if flush and ts in recorded.columns:  # a pipeline without state passes the marker on
        recorded = recorded.where(F.col(ts) < F.lit(END_OF_TIME))
    return recorded


def record_with_timestamps(
    source: DataFrame, subject: Callable[[DataFrame], DataFrame], name: str, flush: bool = True, ts: str = "ts"
) -> DataFrame:
    """:func:`record_stream` with each output row's event time in milliseconds as ``tms``."""
    return record_stream(source, lambda s: subject(s).withColumn("tms", F.unix_millis(ts)), name, flush=flush, ts=ts)
