"""Prefix trie of conversations, by double-array tries per prefix shard.

Conversations are sequences of turns. Every distinct sequence of first turns is a node of one trie, named
by a running hash of its turns. Four steps:

1. Turns are numbered and the prefixes of every conversation hashed. Equal conversations become one
   sequence with a weight, so thousands of copies are one path.
2. The depth at which the sequences part is found by doubling: while more than ``UNIT_TURNS`` turns lie
   below one prefix, its sequences are parted by a prefix of twice the depth. What lies above are the shared upper
   nodes; what lies below goes to one shard as a whole.
3. A shard gives its turns dense ids, packs its nodes into BASE and CHECK arrays (a child of node *s* by
   turn *t* is slot BASE[s] + t, and CHECK[slot] = s), follows every sequence through the arrays to count
   members, and adds subtrees up from the deepest level.
4. Upper nodes come from many shards: their members are added up globally, and their subtrees by
   doubling steps over ancestors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialised

# Turns that may lie below one prefix before its sequences are parted further down, and turns of a shard.
UNIT_TURNS, SHARD_TURNS = 20_000, 60_000
# Turns that a conversation takes over at most, in the contract's rule.
MOST_SHARED = 8
# Slots tried for a node's children before they go to the end of the arrays.
_TRIES = 32
_BLOB = 1 << 16


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, idx, turn_key, bytes``: turns in order, from 1; ``bytes`` is the length of the text in UTF-8."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    return text.select("conv_id", F.row_number().over(order).cast("long").alias("idx"), key.alias("turn_key"), F.octet_length("text").cast("long").alias("bytes"))


def sharing(conv_id: Column) -> tuple[Column, Column]:
    """Whose first turns a conversation takes over, and how many: the contract's rule."""
    return F.try_subtract(conv_id, F.pmod(conv_id, F.lit(5))), F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED + 1))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_key, bytes``: every conversation with the first turns of another before its own.

    A conversation that takes over no turn has a row with a NULL ``pos`` besides its own. At most ``MOST_SHARED`` turns of a
    conversation are brought together.
    """
    heads = turns.where(F.col("idx") <= MOST_SHARED).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "turn_key", "bytes"))).alias("head"))
    of, h = sharing(F.col("conv_id"))
    wanted = heads.select("conv_id", of.alias("of"), h.cast("int").alias("h"))
    taken = wanted.join(heads.select(F.col("conv_id").alias("of"), "head"), "of", "left")
    taken = taken.select("conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<idx:bigint,turn_key:string,bytes:bigint>>")), F.lit(1), F.col("h")).alias("head"))
    first = taken.select("conv_id", F.inline_outer("head")).withColumnRenamed("idx", "pos")
    own = turns.join(taken.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("idx > h")
    return first.unionByName(own.select("conv_id", (F.col("n") + F.col("idx") - F.col("h")).alias("pos"), "turn_key", "bytes"))


def prefixes(turns: DataFrame) -> DataFrame:
    """The turns with ``k1, k2``, the hash of all turns up to each, and ``p1, p2``, that up to the one before.

    A prefix is the exclusive or of a hash of every turn with its position: two independent hashes of 64 bits.
    """
    over = W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    for name, salt in (("1", 11), ("2", 12)):
        own = F.when(F.col("pos").isNotNull(), F.xxhash64(F.lit(salt), "pos", "turn_key"))
        turns = turns.withColumn(f"h{name}", own).withColumn(f"k{name}", F.bit_xor(f"h{name}").over(over))
    return turns.select("conv_id", "pos", "turn_key", "bytes", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"))


def _end_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal ids of neighbouring rows of one node, joined, in pieces of bounded size."""
    names, kinds = ["k1", "k2", "depth", "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    node, ids, size, done = None, [], 0, []
    for batch in batches:
        for k1, k2, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2, depth) != node or size > _BLOB:
                if ids:
                    done.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids, size = (k1, k2, depth), [], 0
            ids.append(conv)
            size += 8
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done = []
    if ids:
        done.append((*node, ids[0], ",".join(map(str, ids))))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node in order, streamed."""
    names, kinds = ["k1", "k2", "depth", "ends_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    node, sha, done = None, None, []
    for batch in batches:
        for k1, k2, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2, depth) != node:
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = (k1, k2, depth), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done = []
    if node:
        done.append((*node, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)


def ends(whole: DataFrame, parts: int) -> DataFrame:
    """``k1, k2, depth, ends_sha256`` of the nodes at which conversations end; input: ``k1, k2, depth, conv_id``.

    Ids are dealt by node and id and joined where they lie; SHA-256 goes over a node's pieces one after the
    other, so one task streams the pieces of a node.
    """
    keys = ["k1", "k2", "depth"]
    laid = whole.select(*keys, "conv_id").repartitionByRange(parts, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    pieces = map_arrow(laid, _end_blobs, "k1 long, k2 long, depth long, first long, ids string")
    streamed = pieces.repartition(parts, *keys).sortWithinPartitions(*keys, "first")
    return map_arrow(streamed.select(*keys, "ids"), _end_digests, "k1 long, k2 long, depth long, ends_sha256 string")


class DoubleArray:
    """BASE and CHECK over dense turn ids; slot 0 is the root, and a free slot has CHECK -1."""

    def __init__(self, nodes: int):
        self.base = np.zeros(2 * nodes + 16, np.int64)
        self.check = np.full(2 * nodes + 16, -1, np.int64)
        self.check[0] = 0
        self.free, self.end = 1, 1

    def _fits(self, slots: np.ndarray) -> bool:
        inside = slots[slots < self.end]
        return bool((self.check[inside] < 0).all())

    def add(self, node: int, turns: np.ndarray) -> np.ndarray:
        """Place the children of a node by their ascending turn ids; their slots."""
        gaps, at = turns - turns[0], self.free
        for _ in range(_TRIES):
            while at < self.end and self.check[at] >= 0:
                at += 1
            if self._fits(gaps + at):
                break
            at += 1
        else:
            at = self.end
        slots = gaps + at
        self._reach(int(slots[-1]) + 1)
        self.base[node] = at - turns[0]
        self.check[slots] = node
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1
        return slots

    def _reach(self, end: int) -> None:
        self.end = max(self.end, end)
        if self.end > len(self.base):
            more = self.end
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def child(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Slots of the children by one turn each; all must exist."""
        slots = self.base[nodes] + turns
        if not (self.check[slots] == nodes).all():
            raise AssertionError("a turn leads out of the trie")
        return slots


def pack(starts: np.ndarray, lengths: np.ndarray, turns: np.ndarray) -> DoubleArray:
    """The trie of sequences: sequence *i* is ``turns[starts[i] : starts[i] + lengths[i]]``."""
    trie = DoubleArray(len(turns))
    at, depth = np.zeros(len(starts), np.int64), 0
    live = np.flatnonzero(lengths > 0)
    while len(live):
        step = turns[starts[live] + depth]
        order = np.lexsort((step, at[live]))
        nodes, steps = at[live][order], step[order]
        new = np.ones(len(order), bool)
        new[1:] = (nodes[1:] != nodes[:-1]) | (steps[1:] != steps[:-1])
        nodes, steps = nodes[new], steps[new]
        cuts = np.flatnonzero(np.diff(nodes)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(nodes)], strict=True):
            trie.add(int(nodes[a]), steps[a:b])
        at[live] = trie.child(at[live], turns[starts[live] + depth])
        depth += 1
        live = live[lengths[live] > depth]
    return trie


_SEQUENCES = "conv_id long, n long, cut long, pos long, turn_key string, bytes long, k1 long, k2 long"
_NODES = "k1 long, k2 long, depth long, p1 long, p2 long, bytes long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, upper boolean, top boolean"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard, from its turns in order of conversation and position.

    Of upper nodes the members are those in this shard and the subtree counts are zero.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    conv, n, cut, size, k1, k2 = (table.column(c).to_numpy() for c in ("conv_id", "n", "cut", "bytes", "k1", "k2"))
    turns = table.column("turn_key").combine_chunks().dictionary_encode()
    turns = (turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns).indices.to_numpy().astype(np.int64) + 1
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    lengths = np.diff(np.r_[starts, len(conv)])
    trie = pack(starts, lengths, turns)
    slots = trie.end
    members, smallest = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    depths, row, upper = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, bool)
    at, depth, levels = np.zeros(len(starts), np.int64), 0, []
    live = np.arange(len(starts))
    while len(live):
        rows = starts[live] + depth
        depth += 1
        at[live] = here = trie.child(at[live], turns[rows])
        np.add.at(members, here, n[rows])
        np.minimum.at(smallest, here, conv[rows])
        depths[here], row[here], upper[here] = depth, rows, depth < cut[rows]
        levels.append(np.unique(here))
        live = live[lengths[live] > depth]
    saved = np.zeros(slots, np.int64)
    used = np.concatenate(levels)
    saved[used] = np.where(upper[used], 0, (members[used] - 1) * size[row[used]])
    children = np.zeros(slots, np.int64)
    leaves = np.zeros(slots, np.int64)
    for level in reversed(levels):
        leaves[level] += ~upper[level] & (children[level] == 0)
        up = trie.check[level]
        inner = ~upper[up] & (up > 0)
        np.add.at(children, up, 1)
        np.add.at(leaves, up[inner], leaves[level][inner])
        np.add.at(saved, up[inner], saved[level][inner])
    up = trie.check[used]
    first = depths[used] == 1
    above = row[up]
    columns = [k1[row[used]], k2[row[used]], depths[used], np.where(first, 0, k1[above]), np.where(first, 0, k2[above]), size[row[used]], smallest[used], members[used], np.where(upper[used], 0, children[used]), leaves[used], saved[used], upper[used], ~upper[used] & (first | upper[up])]
    names = [f.split()[0] for f in _NODES.split(", ")]
    for lo in range(0, len(used), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in columns], names)


def _cuts(turns: DataFrame, sequences: DataFrame, unit_turns: int) -> DataFrame:
    """``conv_id, cut, unit``: the depth from which a sequence is in one shard, and what its shard goes by.

    The prefixes of one depth part all sequences that are left; those below a prefix with few turns are done. A
    sequence that ends above has upper nodes only.
    """
    left, depth, done = sequences.select("conv_id", "length"), 1, None
    while True:
        here = left.join(turns.where(F.col("pos") == depth).select("conv_id", "k1", "k2"), "conv_id", "left")
        load = here.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.sum(F.col("length") - (depth - 1)).alias("load"), F.count(F.lit(1)).alias("paths"))
        busy = load.where((F.col("load") > unit_turns) & (F.col("paths") > 1)).select("k1", "k2", F.lit(True).alias("busy"))
        marked = materialised(here.join(busy, ["k1", "k2"], "left"), "prefixes")
        ended, parted = F.col("k1").isNull(), F.col("busy").isNull()
        found = marked.where(parted).select("conv_id", F.when(ended, F.col("length") + 1).otherwise(F.lit(depth)).alias("cut"), F.when(ended, F.xxhash64("conv_id")).otherwise(F.col("k1")).alias("unit"))
        done = found if done is None else done.unionByName(found)
        left = marked.where("busy").select("conv_id", "length")
        if left.isEmpty():
            return done
        depth *= 2


def _upper(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """Upper nodes and the root with the aggregates of all shards."""
    keys = ["k1", "k2", "depth"]
    parents = [F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    shared = nodes.where("upper").groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("p1", "p2", "bytes")], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    shared = materialised(shared.unionByName(root), "upper")
    attached = nodes.where("top").select(*parents, "n_leaves", "saved").unionByName(shared.where("depth > 0").select(*parents, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
    below = attached.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    state = shared.join(below, keys, "left").select(
        *keys, "p1", "p2", "conv_id", "n_convs", "bytes", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("l", F.lit(1)).alias("n_leaves"), (F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    state, reach = materialised(state, "upper"), 1
    deepest = state.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        low = state.where(F.col("depth") >= reach).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        jump = state.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("depth").alias("at"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        state = state.join(low, keys, "left").withColumn("at", F.col("depth") - reach).join(jump, ["a1", "a2", "at"], "left")
        state = state.select(*keys, "p1", "p2", "conv_id", "n_convs", "bytes", "n_children", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("b1").alias("a1"), F.col("b2").alias("a2"))
        state, reach = materialised(state, "upper"), 2 * reach
    return state


def trie_nodes(turns: DataFrame, unit_turns: int = UNIT_TURNS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node.

    Input: ``conv_id, pos, turn_key, bytes`` with positions from 1; rows with a NULL ``pos`` are no turns, so
    that a conversation without any can be a member of the root, which has depth 0.
    """
    spark = turns.sparkSession
    table = materialised(prefixes(turns), "turns")
    real = table.where("pos IS NOT NULL")
    size = F.max(F.struct("pos", "k1", "k2"))
    whole = table.groupBy("conv_id").agg(F.coalesce(F.max("pos"), F.lit(0)).alias("depth"), size.alias("end"))
    whole = materialised(whole.select("conv_id", "depth", *[F.when(F.col("depth") > 0, F.col(f"end.{k}")).otherwise(F.lit(0)).alias(k) for k in ("k1", "k2")]), "ends")
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = whole.agg(F.sum("depth")).first()[0] or 0
    shards = max(floor, math.ceil(total / SHARD_TURNS))
    sequences = whole.groupBy("k1", "k2", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    sequences = materialised(sequences.where("depth > 0").select("conv_id", "n", F.col("depth").alias("length")), "sequences")
    cuts = _cuts(real, sequences, unit_turns)
    placed = real.select("conv_id", "pos", "turn_key", "bytes", "k1", "k2").join(sequences.select("conv_id", "n").join(cuts, "conv_id"), "conv_id")
    dealt = placed.repartition(shards, F.col("unit")).sortWithinPartitions("conv_id", "pos")
    nodes = materialised(map_arrow(dealt.select(*[f.split()[0] for f in _SEQUENCES.split(", ")]), _shard, _NODES), "nodes")
    zero = F.lit(0).cast("long")
    root = whole.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in ("k1", "k2", "depth")], *[zero.cast("long").alias(c) for c in ("p1", "p2", "bytes")], "conv_id", "n_convs")
    columns = ["k1", "k2", "depth", "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    every = materialised(nodes.where("NOT upper").select(columns).unionByName(_upper(nodes, root).select(columns)), "all-nodes")
    parent = every.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = every.withColumn("above", F.col("depth") - 1).join(parent, ["p1", "p2", "above"], "left").join(ends(whole, shards), ["k1", "k2", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations; columns as in ``trie_nodes``.

    Turns are ordered by ``turn`` (NULL first), ties by role and text; repeated rows are turns of their own;
    NULL roles and texts are empty. Rows without a ``conv_id`` belong to no conversation and are not used. An
    empty table has no node, not even a root. Other columns are not read. One task puts the turns of a conversation in order.
    """
    return trie_nodes(rebuilt(materialised(numbered(conversations), "numbered")))


# The same by SQL.
NODES_SQL = r"""
WITH crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) AS r(i)
),
turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx,
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS source,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc
),
rebuilt AS (
    SELECT c.conv_id, 0 AS part, idx, key, bytes FROM convs c JOIN turns t ON t.conv_id = c.source WHERE idx <= h
    UNION ALL SELECT c.conv_id, 1, idx, key, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE idx > h
),
whole AS (
    SELECT conv_id, coalesce(keys, []) AS keys, sizes
    FROM convs LEFT JOIN (SELECT conv_id, list(key ORDER BY part, idx) AS keys, list(bytes ORDER BY part, idx) AS sizes FROM rebuilt GROUP BY conv_id) USING (conv_id)
),
steps AS (
    SELECT conv_id, d, sha256(array_to_string(keys[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(keys[1:d - 1], ',')) END AS parent,
        CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, d = len(keys) AS ends
    FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM whole)
),
nodes AS (
    SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, (count(*) - 1) * any_value(bytes) AS own,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM steps GROUP BY node, d
),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node AS node FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
    SELECT top AS node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(own)::BIGINT AS saved_tokens
    FROM below JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.node JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node
"""
