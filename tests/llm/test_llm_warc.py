import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from tidemark.llm import warc
from tidemark.session import scratch_path


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, row int")


BIG, BIG2 = "é" * 600 + "\r\n\r\nWARC/1.1\r\n\r\n", "y" * 1000
ROWS = [
    (1, "http://a.example/x?q=1#f", BIG), (2, "https://b.example", BIG), (3, None, BIG), (4, "not a url", BIG2), (5, "http://c/\r\nX: y", BIG2[:-1]), (6, "u", BIG2[:-1]),
    (7, "u", None), (8, "u", ""), (9, "u", "\r\n\r\n"), (None, "u", BIG), (None, None, None), (10, "u", "z" * 200_000), (11, "http://h", BIG2), (11, "http://h", BIG2), (-3, "u", "only one" * 200),
]


def expected(rows):
    groups = defaultdict(list)
    for n, (page, _, html) in enumerate(rows):
        groups[(html or "").encode()].append((page is not None, page or 0, n, page))
    out = []
    for payload, pages in groups.items():
        best = max(pages)
        for p in pages:
            again = len(payload) >= 1000 and p is not best
            out.append((p[3], len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", best[3] if again else None))
    return sorted(out, key=str)


def test_pages_read_back(spark):
    got = sorted(map(tuple, warc.page_digests(table(spark, ROWS)).collect()), key=str)
    assert got == expected(ROWS)


def test_empty_table(spark):
    assert warc.page_digests(table(spark, [])).count() == 0


def test_archives_are_warc(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(table(spark, ROWS), folder)
    files = spark.read.format("binaryFile").load(folder).collect()
    records = [r for f in files for r in warc.parse(io.BufferedReader(io.BytesIO(gzip.decompress(f.content))))]
    kinds = [r[1] for r in records]
    assert kinds.count("request") == kinds.count("metadata") == len(ROWS) and kinds.count("revisit") == 5
    ids = {r[0] for r in records}
    assert len(ids) == len(records) and all(r[2] in ids for r in records if r[1] in ("request", "metadata")) and all(r[3] in ids for r in records if r[1] == "revisit")


def test_assembly_by_identifiers(spark):
    def record(rid, kind, to=None, payload=b""):
        return (rid, kind, to, None, "u", "t", bytearray(payload), len(payload), "d")

    found = spark.createDataFrame(
        [record("r1", "response"), record("q2", "request", "r1", b"b"), record("q1", "request", "r1", b"a"), record("m1", "metadata", "r1"), record("m2", "metadata", "r1"), record("r2", "revisit"), record("w", "warcinfo"), record("q9", "request", "gone"), record(None, "metadata", "gone")],
        warc.FIELDS,
    )
    got = {r.capture_id: r for r in warc.assemble(found).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.record_id == "q1" and [m.record_id for m in got["r1"].metadata] == ["m1", "m2"]
    assert got["r2"].request is None and got["r2"].metadata is None
    assert warc.orphans(found).count() == 2


def test_broken_archives_fail():
    for data in (b"junk\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nContent-Length: 9"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BufferedReader(io.BytesIO(data))))
