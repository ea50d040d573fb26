"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits over word shingles. For a radius of two bits, seven structured masks cover
every pair: position *i* belongs to one of the seven non-zero vectors of GF(2)^3, and mask *v* keeps
the positions whose vector has an odd product with *v*. Two differing positions span at most two of
the three dimensions, so some *v* is orthogonal to both and its mask drops exactly them: the pair
agrees under that mask. No pair is missed, whatever the data.

Inside a bucket no pairs are enumerated. A member stands for itself and for its one-bit changes in
the positions that the mask drops; fingerprints within two bits meet at a common change, and all that
meet there are within two bits of each other. Such a meeting point holds at most 65 distinct
fingerprints, so a bucket of any size costs rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialised, row_key

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
_CHUNK = 1 << 14
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    """Signed 64-bit fingerprint from the counts of ``n`` hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed fingerprint of unsigned 64-bit hashes; bit i is set if it is set in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += _ones(hashes[at : at + _CHUNK])
    return _majority(ones, len(hashes))


def _fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a text: that of the hashes of all its shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        part = tokens[lo : hi + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if len(tokens) >= SHINGLE else [b" ".join(tokens)]
        ones += _ones(np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=hi - lo))
    return _majority(ones, n)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([_fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["doc_id", "rk", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, fp``: one row per document. NULL and blank texts have fingerprint 0.

    ``rk`` is the row's key: rows that agree in id and text share it.
    """
    return map_arrow(docs.select("doc_id", row_key().alias("rk"), "text"), _fingerprint_batches, "doc_id long, rk long, fp long")


def cover_masks() -> list[int]:
    """The seven masks; of any two bit positions, some mask drops both."""
    kind = [i % 7 + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(kind[i] & v).count("1") % 2) for v in range(1, 8)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def close_pairs(prints: DataFrame) -> DataFrame:
    """``a, b`` (a > b): links that connect exactly what is within two bits; input: distinct ``fp``.

    The links form stars over groups in which all members are within two bits of each other.
    """
    masks = cover_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for t, m in enumerate(masks)])
    placed = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.bucket")
    shared = placed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "bucket")
    met = placed.join(shared, ["t", "bucket"], "left_semi")
    changes = F.element_at(
        F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks]),
        F.col("t") + 1,
    )
    variants = met.select("fp", F.explode(changes).alias("change")).select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("variant"))
    groups = variants.groupBy("variant").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    star = groups.select(F.array_min("members").alias("b"), F.explode("members").alias("a"))
    return star.where("a != b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of ``edges(a, b)`` that is not the smallest of its component.

    Alternating large-star and small-star rounds; each round is written to the shared folder. Grouping
    combines map-side and a star with very many leaves is a join that adaptive execution splits.
    """
    e = materialised(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = _state(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialised(small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(e: DataFrame) -> tuple:
    """Row count and order-free checksums of an edge table: equal only if nothing changed."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, fp, root``: one row per document; ``root`` is the fingerprint that names its component.

    Documents with equal fingerprints are one node from the start, so a group of copies of any size is
    one row in the search.
    """
    prints = materialised(fingerprints(docs), "fingerprints")
    nodes = prints.select("fp").distinct()
    roots = components(close_pairs(nodes))
    return prints.join(roots, prints.fp == roots.node, "left").select("doc_id", "rk", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest ``doc_id`` that
    links reach. NULL texts count as empty; empty texts have fingerprint zero and are linked like any
    other. A NULL ``doc_id`` is a component's id only if it has no other. Repeated rows stay repeated.
    Other columns are not read.
    """
    linked = classes(docs)
    smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return linked.join(smallest, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = classes) -> DataFrame:
    """One row of ``docs``, all columns, for each near-duplicate group: that with the smallest ``doc_id``.

    ``find`` gives the groups (``doc_id, rk, root``); by default they are those of the fingerprints. The
    pipeline's (``jaccard.classes``) checks what the covering tables bring together on the whole sets.
    Rows without an id lose to rows with one; ties go to the smaller row key, and of repeated rows one
    is kept. Which document stays depends on ids and texts only.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    chosen = find(docs).groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.rk").alias("__rk"))
    kept = docs.withColumn("__rk", row_key()).join(materialised(chosen, "representatives"), "__rk", "left_semi")
    return kept.dropDuplicates(["__rk"]).drop("__rk")
