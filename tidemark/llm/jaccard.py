"""Near duplicates by the Jaccard similarity of word shingles.

Two texts are near copies if their sets of five-word shingles (lower-cased ASCII, one shorter shingle for
a text of fewer words) have a similarity of 0.8 or more. Every candidate pair that matters is verified on
the whole sets; texts with equal sets are one node from the start.

The search begins with SimHash: a set has the 64-bit fingerprint of its shingles, the covering tables of
``simhash.py`` bring together all fingerprints within two bits, and what the exact check confirms is linked.
Near copies at the threshold differ in about ten bits, more than covering tables can span, so the links
still missing are sought in the bands of a MinHash signature: 48 bands of five minima, so that a pair at
exactly 0.8 shares no band with probability (1 - 0.8^5)^48 = 5e-9.

Only components are wanted, so pairs whose ends are linked already need no check. Large groups are joined
first: in every band bucket over several components, each member is checked against one hub, which is linear.
When such a turn adds few links, what is left open is searched by a prefix filter over the whole sets of
those texts. Shingles are put in one order, rarest first; two sets of similarity 0.8 share one of the first
ninth of the smaller and the first fifth of the larger, and what precedes the first one shared bounds the
overlap. A passage that many unlike texts share is frequent and comes last in all of them, so it makes no
candidates, whatever bands they have in common. Nothing is capped, and no such pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialised, row_key
from tidemark.llm.simhash import close_pairs, components, fingerprint_of

SHINGLE = 5
# The least similarity, as a fraction.
ALIKE = (4, 5)
BANDS, ROWS = 48, 5
# A turn of hubs that links fewer than one in so many open texts is the last.
HUB_YIELD = 20
# Size classes in the prefix filter: each spans sizes in a ratio of exp(1 / CLASSES).
CLASSES = 32
_CHUNK = 1 << 13
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    n = max(1, len(tokens) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(tokens[i : i + SHINGLE])) for i in range(n)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Bucket of a non-empty set in each band."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _CHUNK):
        low = np.minimum(low, ((short[at : at + _CHUNK, None] ^ _XOR) * _TIMES).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), band) for band, r in enumerate(rows)], np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    """Key of a set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, prints, keys = [], [], [], []
        for text in batch.column(2):
            h = shingles(text.as_py())
            nodes.append(_node(h))
            sizes.append(len(h))
            prints.append(fingerprint_of(h))
            keys.append(bands(h) if len(h) else h.view(np.int64))
        columns = [*(pa.array(x, pa.int64()) for x in (nodes, sizes, prints)), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "rk", "node", "size", "fp", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, node, size, fp, bands``: one row per document; all but the first two are the set's."""
    schema = "doc_id long, rk long, node long, size long, fp long, bands array<long>"
    return map_arrow(docs.select("doc_id", row_key().alias("rk"), "text"), _signature_batches, schema)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "set"])


def alike(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` elements in common are near copies."""
    return shared * ALIKE[1] >= (a + b - shared) * ALIKE[0]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: those of ``pairs(a, size_a, b, size_b)`` that are near copies."""
    pairs = pairs.where(alike(F.least("size_a", "size_b"), F.col("size_a"), F.col("size_b"))).select("a", "b").distinct()
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(alike(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"))).select("a", "b")


def _rooted(frame: DataFrame, roots: DataFrame) -> DataFrame:
    """The frame with the component of its nodes."""
    return frame.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _ends(frame: DataFrame, end: str) -> DataFrame:
    return frame.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("size", "root")], F.col("node").alias(end))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * CLASSES).cast("int")


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """``a, size_a, b, size_b``: pairs of ``node, root, set`` with different roots that may be near copies.

    Complete: every pair of similarity 0.8 or more is there. A shingle at place *i* of a set of size *n* can
    be the first one shared only with sizes up to (9 (n - i) - 4 n) / 4, so the larger side of a pair is
    written out for the size classes it can still meet.
    """
    rows = materialised(sets.select("node", F.explode("set").alias("shingle")), "open-shingles")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    ranked = rows.join(common, "shingle", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "shingle"))).alias("order"))
    size = F.size("order").cast("long")
    first = F.slice("order", F.lit(1), (size - F.ceil(size * ALIKE[0] / ALIKE[1]) + 1).cast("int"))
    placed = ranked.select("node", size.alias("size"), F.posexplode(first).alias("place", "x")).where("x.uses > 1").select("node", "size", F.col("place").cast("long").alias("place"), "x.shingle")
    placed = materialised(placed.join(sets.select("node", "root"), "node"), "prefixes")
    # A pair of sizes a and b overlaps in at least 4 (a + b) / 9.
    num, den = ALIKE[0], ALIKE[0] + ALIKE[1]
    smaller = placed.where((F.col("size") - F.col("place")) * den >= F.col("size") * (2 * num))
    smaller = smaller.select("shingle", _size_class(F.col("size")).alias("class"), *[F.col(c).alias(f"{c}_b") for c in ("size", "place", "root")], F.col("node").alias("b"))
    most = F.least(F.col("size"), F.floor(((F.col("size") - F.col("place")) * den - F.col("size") * num) / num))
    least = F.ceil(F.col("size") * ALIKE[0] / ALIKE[1])
    meets = F.explode(F.sequence(_size_class(least), _size_class(most)))
    larger = placed.where(most >= least).select("shingle", meets.alias("class"), *[F.col(c).alias(f"{c}_a") for c in ("size", "place", "root")], F.col("node").alias("a"))
    overlap = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    met = larger.join(smaller, ["shingle", "class"]).where((F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") > F.col("b"))))
    met = met.where((F.col("root_a") != F.col("root_b")) & (overlap * den >= (F.col("size_a") + F.col("size_b")) * num))
    return met.select("a", "size_a", "b", "size_b")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``a, size_a, b, size_b``: pairs of distinct ``node, size, fp`` that the covering tables bring together.

    Every node is paired with the first of its own fingerprint, and those of close fingerprints with each
    other, so the pairs are linear in the nodes.
    """
    first = nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("x")).select("fp", "x.node", "x.size")

    def end(frame: DataFrame, x: str, fp: str) -> DataFrame:
        return frame.select(F.col("fp").alias(fp), F.col("node").alias(x), F.col("size").alias(f"size_{x}"))

    same = end(nodes, "a", "fp").join(end(first, "b", "fp"), "fp").where("a != b")
    near = close_pairs(nodes.select("fp").distinct()).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    near = near.join(end(first, "a", "fp_a"), "fp_a").join(end(first, "b", "fp_b"), "fp_b")
    return same.drop("fp").unionByName(near.drop("fp_a", "fp_b"))


def linked_nodes(members: DataFrame, sets: DataFrame, close: DataFrame) -> DataFrame:
    """``node, root`` of the nodes that near copies link.

    Input: ``key, node, size``, ``node, set`` and the pairs that fingerprints gave.
    """
    turn, found = 0, None
    edges = materialised(_verified(close, sets), "near-copies")
    roots = components(edges)
    while True:
        rooted = _rooted(members, roots)
        buckets = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
        live = materialised(rooted.join(buckets.select("key", "n"), "key"), "live")
        left = live.select("node", "root").distinct()
        n_left = left.count()
        if not n_left:
            return roots
        if found is not None and found * HUB_YIELD < n_left:
            break
        # A text that meets most others lies in the middle of its group; later hubs are arbitrary.
        order = F.struct("weight", F.xxhash64("node", F.lit(turn)), "node", "size", "root")
        weights = live.groupBy("node").agg((F.sum("n") if turn == 0 else F.lit(0)).alias("weight"))
        hubs = live.join(weights, "node").groupBy("key").agg(F.max(order).alias("hub")).select("key", "hub.*")
        ends = _ends(live, "a").join(_ends(hubs, "b"), "key").where("root_a != root_b")
        links = materialised(_verified(ends, sets), "near-copies")
        found = links.count()
        if found:
            edges = edges.union(links)
            roots = components(edges)
        members, turn = live.select("key", "node", "size"), turn + 1
    links = materialised(_verified(prefix_pairs(materialised(left.join(sets, "node"), "open-sets")), sets), "near-copies")
    if links.isEmpty():
        return roots
    return components(edges.union(links))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, root``: one row per document; ``root`` names its component of near copies.

    NULL and blank texts have no shingles and are copies of each other.
    """
    table = materialised(signatures(docs), "signatures")
    close = materialised(fingerprint_pairs(table.select("node", "size", "fp").distinct()), "close-fingerprints")
    placed = table.select("node", "size", "bands").dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = materialised(placed.join(shared, "key", "left_semi"), "bands")
    sought = members.select("node").union(close.select("a")).union(close.select("b")).distinct()
    chosen = table.join(sought, "node", "left_semi").groupBy("node").agg(F.min("rk").alias("__rk")).select("__rk")
    texts = docs.withColumn("__rk", row_key()).select("__rk", "text").join(chosen, "__rk", "left_semi").dropDuplicates(["__rk"]).select("text")
    sets = materialised(map_arrow(texts, _set_batches, "node long, set array<long>"), "sets")
    return _rooted(table.select("doc_id", "rk", "node"), linked_nodes(members, sets, close)).select("doc_id", "rk", "root")
