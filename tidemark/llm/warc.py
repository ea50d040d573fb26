"""WARC archives of web captures: write, read back, assemble transactions.

A capture is three records: the response (or a revisit of an equal payload), the request and a metadata
record; the latter two name the first in ``WARC-Concurrent-To``. Records of one capture may be anywhere in
the archives. ``assemble`` joins them through these identifiers into one nested row per capture.

Archives are written by Spark's text writer (one file per task, gzip, committed with the job), with the
record terminator as line separator, so no Python touches a payload on the way out and any file system that
Spark knows will do. They are read as whole files and parsed record by record, by the lengths in the headers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow
from tidemark.session import scratch_path

CRLF = "\r\n"
# Payloads below this size are always stored; larger equal ones once.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
_FLUSH_BYTES = 8 << 20


def _record_id(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), row.cast("string")))
    parts = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(pages: DataFrame) -> DataFrame:
    """``row, page_id, url, payload, digest``: a page per row, numbered; the payload is the html in UTF-8."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))


def with_originals(rows: DataFrame) -> DataFrame:
    """Adds ``original``: the row whose payload this one repeats, or NULL if it is stored itself."""
    groups = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", F.col("best.row").alias("best"))
    )
    return rows.join(groups, "digest", "left").withColumn("original", F.when(F.col("best") != F.col("row"), F.col("best"))).drop("best")


def _record(kind: Column, record_id: Column, url: Column, more: list[Column], content_type: str, block: Column) -> Column:
    line = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    header = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {CAPTURE_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), line),  # NULL: no such line
        *more,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(header, F.lit(CRLF * 2), block)


def records(rows: DataFrame) -> DataFrame:
    """``value``: the three records of every capture, without their final terminator."""
    url, row = F.col("url"), F.col("row")
    main = _record_id("response", row)
    revisit = F.col("original").isNotNull()
    payload = F.col("payload").cast("string")  # bytes as they are
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    to = F.concat(F.lit("WARC-Concurrent-To: "), main)
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), main, url,
        [
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id("response", F.col("original")))),
        ],
        "application/http;msgtype=response", F.when(revisit, http).otherwise(F.concat(http, payload)),
    )
    split = F.regexp_replace(url, "[\r\n ]", "")
    path = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(split, "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", ""), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract(split, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    request = _record(F.lit("request"), _record_id("request", row), url, [to], "application/http;msgtype=request", F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    page = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _record(F.lit("metadata"), _record_id("metadata", row), url, [to], "application/warc-fields", page)
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write the captures of ``pages(page_id, url, html)`` as gzip-compressed WARC files in ``folder``."""
    records(with_originals(captures(pages))).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(folder)


FIELDS = (
    "record_id string, warc_type string, concurrent_to string, refers_to string, url string, content_type string, "
    "payload binary, payload_bytes long, payload_digest string"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_KINDS = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[f.split()[1]] for f in FIELDS.split(", ")]


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of one uncompressed archive. Digest and size are those of the payload that was read."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("truncated WARC header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("truncated WARC record")
        payload = block
        if head.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        yield (
            head.get("warc-record-id"), head.get("warc-type"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
            head.get("warc-target-uri"), head.get("content-type"), payload, len(payload), hashlib.sha1(payload).hexdigest(),
        )


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)
            rows, size = [], 0
            for record in parse(stream):
                rows.append(record)
                size += record[7]
                if size > _FLUSH_BYTES or len(rows) >= 1000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all archives below a folder; see ``FIELDS``. A broken record fails the job."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return map_arrow(files, _parse_files, FIELDS)


def assemble(found: DataFrame) -> DataFrame:
    """``capture_id, response, request, metadata``: one nested row per response or revisit record.

    Requests and metadata come by their concurrent-to identifier. ``request`` is the one with the smallest
    record id, or NULL; ``metadata`` is an array ordered by record id, or NULL. Requests and metadata that
    name no response are in no row; ``orphans`` has them.
    """
    fields = ["record_id", "url", "content_type", "payload"]
    main = found.where(F.col("warc_type").isin("response", "revisit"))
    others = found.where("concurrent_to IS NOT NULL").select("concurrent_to", "warc_type", F.struct(*fields).alias("r"))
    request = others.where("warc_type = 'request'").groupBy("concurrent_to").agg(F.min_by("r", "r.record_id").alias("request"))
    metadata = others.where("warc_type = 'metadata'").groupBy("concurrent_to").agg(F.sort_array(F.collect_list("r")).alias("metadata"))
    response = F.struct("record_id", "warc_type", "refers_to", "url", "content_type", "payload", "payload_bytes", "payload_digest").alias("response")
    return (
        main.join(request.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
        .join(metadata.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
        .select(F.col("record_id").alias("capture_id"), response, "request", "metadata")
    )


def orphans(found: DataFrame) -> DataFrame:
    """Request and metadata records that name no response or revisit."""
    main = found.where(F.col("warc_type").isin("response", "revisit")).select(F.col("record_id").alias("concurrent_to"))
    return found.where(F.col("warc_type").isin("request", "metadata")).join(main, "concurrent_to", "left_anti")


def page_id_of(metadata: Column) -> Column:
    """The page id in the first metadata record that has one."""
    ids = F.transform(metadata, lambda m: F.nullif(F.regexp_extract(F.decode(m["payload"], "UTF-8"), "page_id: (-?[0-9]+)", 1), F.lit("")))
    return F.get(F.filter(ids, lambda x: x.isNotNull()), F.lit(0)).cast("long")


def page_digests(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all pages, read from archives.

    Of pages with equal payloads of at least 1000 bytes one is stored: that with the largest ``page_id``
    (NULL is smallest; of repeated rows with that id, one). Revisits show size and digest of the payload of
    the response they refer to, and its page id. NULL html is an empty payload; a NULL url leaves out the
    target line; a NULL ``page_id`` stays NULL. Repeated rows are captures of their own. The frame must give
    the same rows in the same partitions each time it is read, as a table does. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    flat = assemble(read_archives(spark, folder)).select(
        "capture_id", page_id_of(F.col("metadata")).alias("page_id"), F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("target"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
    )
    stored = flat.where("record_type = 'response'")
    original = stored.select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    revisits = flat.where("record_type = 'revisit'").join(original, "target", "left")
    return stored.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    )


DIGESTS_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN o.best <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.best <> p.page_id THEN o.best END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""
