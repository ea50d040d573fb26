"""Which stretches of text can occur in more than one document: anchors and segments.

Both exact substring operators need, for every window of a document (13 words, or 50 bytes), the smallest
id of a document that has the same window. Shuffling every window would cost many times the text. So:

1. Each window names an *anchor*, the smallest hash among the shorter grams inside it. Equal windows name
   equal anchors, and neighbouring windows mostly share one. A block of documents sends the distinct
   anchors it has (packed, two or three bytes each) to shards by hash.
2. A shard answers each block with those of its anchors that another document has too.
3. Windows with such an anchor are candidates. Runs of neighbouring candidates with one anchor are sent
   as *segments* (the bytes they span) to the anchor's shard, equal ones of a block once; the shard finds
   out exactly which windows recur, and answers each block.

Over the edges of a passage that a third of all documents share, windows name anchors inside the passage
but carry words of their own document, so such an anchor has a segment per document. Anchors with more
than HOT_RUNS runs are *hot*: each window of theirs is a segment of its own and goes to the shard that its
own hash names. Equal windows still meet, and all shards get a part.

Hashes only decide where things meet; shards compare the text itself. Blocks and shards are bounded units
of work whose numbers grow with the input. Inside a passage a block sends a segment once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MB, partitions_for, ship

# Parquet megabytes of documents in a block: about twice that in text, a few hundred MB while worked on.
BLOCK_MB = 6
# Anchors in a shard at most (about), so that 31 bits tell them apart well and they fit in memory.
SHARD_ANCHORS = 2_000_000
# Runs of windows with one anchor, over all blocks, from which on the anchor is hot.
HOT_RUNS = 10_000
_FP_BITS = 31
_CODEC = pa.Codec("zstd", compression_level=3)
PIECE = 1 << 20


def blocked(docs: DataFrame) -> DataFrame:
    """``block, doc_id, text`` of the rows that have an id, dealt evenly over blocks by hash."""
    n = partitions_for(docs, BLOCK_MB)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    return docs.where("doc_id IS NOT NULL").select(block, "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shard_count(docs: DataFrame, anchors_per_byte: float) -> int:
    """Shards for the anchors of a table; text is taken as four times its size in Parquet at most."""
    return partitions_for(docs, SHARD_ANCHORS / (4 * anchors_per_byte) / MB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


# Odd multipliers, one for each step of the doubling.
_FACTORS = mixed(np.arange(101, 229, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(unit: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` units, from a 64-bit value per unit, by doubling."""
    out, length, power, width, step = None, 0, unit, 1, 0
    while True:
        if size & width:  # append a run of `width` to what there is
            if out is None:
                out = power
            else:
                n = len(power) - length
                out = out[:n] * _FACTORS[2 * step] + power[length:]
            length += width
        if length == size:
            return mixed(out)
        power = power[:-width] * _FACTORS[2 * step + 1] + power[width:]
        width, step = 2 * width, step + 1


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(anchor: np.ndarray, owner: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of neighbouring windows with one anchor and owner.

    ``owner`` is negative where no window starts. A run that repetitive text would stretch is cut after
    ``longest`` windows.
    """
    if not len(anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    since = np.arange(len(anchor)) - np.repeat(heads, np.diff(np.append(heads, len(anchor))))
    heads = np.flatnonzero(since % longest == 0)
    tails = np.append(heads[1:], len(anchor)) - 1
    keep = owner[heads] >= 0
    return heads[keep], tails[keep]


def split_hot(heads: np.ndarray, tails: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs, of which those marked hot are cut into single windows."""
    if not hot.any():
        return heads, tails
    n = np.where(hot, tails - heads + 1, 1)
    start = np.repeat(heads, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return start, np.where(np.repeat(hot, n), start, np.repeat(tails, n))


def shard_of(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 31-bit fingerprint of anchor hashes."""
    return ((h >> np.uint64(_FP_BITS)) % np.uint64(shards)).astype(np.int64), (h & np.uint64((1 << _FP_BITS) - 1)).astype(np.uint32)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers (or one byte string as uint8), compressed; bytes of equal rank side by side."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c)
        raw = c.view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes()
        squeezed = _CODEC.compress(raw, asbytes=True)
        parts.append(np.array([len(c), len(squeezed)], "<i8").tobytes() + c.dtype.str.encode().ljust(4) + squeezed)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = np.frombuffer(data, "<i8", 2, at).tolist()
        dtype = np.dtype(data[at + 16 : at + 20].decode().strip())
        raw = _CODEC.decompress(data[at + 20 : at + 20 + size], n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype))
        at += 20 + size
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers, as compressed differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    (d,) = unpack(data)
    return np.cumsum(d, dtype=d.dtype)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, with the positions of its values in ascending order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


MESSAGE = "shard int, block int, data binary"


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    shard, block, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(shard, pa.int32()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["shard", "block", "data"])


def recurring_anchors(docs: DataFrame, anchors: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], shards: int) -> DataFrame:
    """Messages to blocks with the anchors of theirs that at least two documents have, and which are hot.

    ``anchors`` gives hash and document id of every run of windows of a block.
    """
    hot_runs = HOT_RUNS
    ship(docs.sparkSession)

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        h, ids = anchors(table)
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads) if len(h) else np.zeros(0, bool)
        shard, fp = shard_of(h[heads], shards)
        value = fp << np.uint32(1) | several
        count = np.diff(np.append(heads, len(h))).astype(np.uint32)
        rows = []
        for s, at in by_shard(shard):
            at = at[np.argsort(value[at], kind="stable")]
            rows.append((s, block, pack(np.diff(value[at], prepend=np.uint32(0)), count[at])))
        return messages(rows)

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        parts = [unpack(x.as_py()) for x in table.column("data")]
        sent = [np.cumsum(v, dtype=v.dtype) for v, _ in parts]
        # Values of one block that share a fingerprint stay several entries: rare, and only more candidates.
        fps = np.concatenate([v >> np.uint32(1) for v in sent])
        order = np.argsort(fps, kind="stable")
        ordered = fps[order]
        same = np.append(ordered[1:] == ordered[:-1], False)
        shared = np.zeros(len(fps), bool)
        shared[order] = same | np.append(False, same[:-1])
        shared |= np.concatenate([v & np.uint32(1) for v in sent]).astype(bool)
        first = np.flatnonzero(~np.append(False, same[:-1]))
        count = np.concatenate([c for _, c in parts])[order].astype(np.int64)
        hot = np.empty(len(fps), bool)
        hot[order] = np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(fps)))) > hot_runs
        rows, at = [], 0
        for block, v in zip(blocks, sent, strict=True):
            keep = shared[at : at + len(v)]
            if keep.any():
                rows.append((shard, block, pack(np.diff(v[keep] >> np.uint32(1), prepend=np.uint32(0)), hot[at : at + len(v)][keep])))
            at += len(v)
        return messages(rows)

    return docs.groupBy("block").applyInArrow(send, MESSAGE).groupBy("shard").applyInArrow(answer, MESSAGE)


def among(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Which of ``sought`` are in ``keys``, which are in ascending order."""
    if not len(keys):
        return np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return keys[at] == sought


class Wanted:
    """The recurring anchors of a block, from the messages to it."""

    def __init__(self, table: pa.Table, shards: int):
        self.shards = shards
        keys, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for s, data in zip(table.column("shard").to_pylist(), table.column("data"), strict=True):
            steps, *flags = unpack(data.as_py())
            key = np.uint64(s) << np.uint64(32) | np.cumsum(steps, dtype=steps.dtype).astype(np.uint64)
            keys.append(key)
            hot += [key[f] for f in flags]
        self.keys, self.hot_keys = np.sort(np.concatenate(keys)), np.sort(np.concatenate(hot))

    def _key(self, h: np.ndarray) -> np.ndarray:
        shard, fp = shard_of(h, self.shards)
        return shard.astype(np.uint64) << np.uint64(32) | fp.astype(np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return among(self.keys, self._key(h))

    def hot(self, h: np.ndarray) -> np.ndarray:
        return among(self.hot_keys, self._key(h)) if len(self.hot_keys) else np.zeros(len(h), bool)
