"""Repeated byte strings by suffix sorting: deep-shallow order of the suffixes of recurring segments.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Candidates come from
anchors (see ``recurring``): grams of 24 bytes, so that a window names the smallest of 27. A shard puts the
distinct segments it gets into one text and sorts the suffixes that start a window:

* *shallow*: multikey quicksort, eight bytes at a time, to a fixed depth; only groups of equal prefixes go
  on to the next eight bytes;
* *deep*: what still is equal there has a long common prefix. Groups that agree in the rest of the window
  are done; in each other group a blind trie, which looks at one distinguishing byte per node and compares
  a string only once in full, orders the members.

Windows that stay together are equal as bytes. Each block is told which parts of its segments recur, and
the first document of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import recurring
from tidemark.llm.recurring import MESSAGE, Wanted, by_shard, messages, pack, unpack

WINDOW = 50
GRAM = 24
GRAMS = WINDOW - GRAM + 1
SHALLOW = 40
STEP = 8
ANCHORS_PER_BYTE = 0.075
_BYTE = recurring.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Block:
    """The documents of a block as one byte array, and its segments piece by piece."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_numpy()
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in table.column("text")]
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - [len(t) for t in texts]

    def segments(self, keyed: bool = True, hot: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Anchor, document, first byte, end byte and key of the segments of each piece.

        Long documents are cut at fixed distances from their start, so the segments of a document do not
        depend on the documents around it. Windows of anchors that ``hot`` names are segments of their own.
        """
        pieces = [(i, lo, min(lo + recurring.PIECE, end - WINDOW + 1)) for i, (start, end) in enumerate(zip(self.starts.tolist(), self.ends.tolist(), strict=True)) for lo in range(start, end - WINDOW + 1, recurring.PIECE)]
        at = 0
        while at < len(pieces):
            to, lo = at, pieces[at][1]
            while to < len(pieces) and pieces[to][2] - lo <= 2 * recurring.PIECE:
                to += 1
            to = max(to, at + 1)
            hi = pieces[to - 1][2]
            part = _BYTE[self.flat[lo : hi + WINDOW - 1]]
            anchor = recurring.sliding_min(recurring.gram_hashes(part, GRAM), GRAMS)
            owner = np.full(hi - lo, -1, np.int64)
            for k in range(at, to):
                owner[pieces[k][1] - lo : pieces[k][2] - lo] = k
            heads, tails = recurring.runs(anchor, owner, GRAMS)
            if hot is not None:
                heads, tails = recurring.split_hot(heads, tails, hot(anchor[heads]))
            doc = np.array([p[0] for p in pieces[at:to]], np.int64)[owner[heads] - at]
            window = recurring.gram_hashes(part, WINDOW) if keyed else None
            keys = _keys(window[heads], window[tails], tails - heads) if keyed else None
            yield anchor[heads], doc, heads + lo, tails + lo + WINDOW, keys
            at = to


def _keys(first: np.ndarray, last: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Key of a segment from the hashes of its first and last window; together they span all its bytes."""
    return recurring.mixed(first * np.uint64(0x9E3779B97F4A7C15) + last + distance.astype(np.uint64))


def _anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    block = Block(table)
    parts = [(h, block.ids[doc]) for h, doc, *_ in block.segments(keyed=False)]
    return (np.concatenate([h for h, _ in parts]), np.concatenate([i for _, i in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _distinct(keys: np.ndarray, low: np.ndarray, high: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """One of the segments of each key, in order of the keys, with the smallest ``low`` and largest ``high``."""
    if not len(keys):
        return keys, low, high, *others
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
    one = order[heads]
    return keys[one], np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads), *(c[one] for c in others)


def _send_segments(shards: int):
    def send(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows or not wanted.num_rows:
            return messages([])
        number = docs.column("block")[0].as_py()
        want, block, parts = Wanted(wanted, shards), Block(docs), []
        for h, doc, first, end, keys in block.segments(hot=want.hot):
            keep = want(h)
            owner = block.ids[doc[keep]]
            parts.append(_distinct(keys[keep], owner, owner, h[keep], first[keep], end[keep]))
        keys, low, high, h, first, end = _distinct(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        if not len(h):
            return messages([])
        hot = want.hot(h)
        shard, _ = recurring.shard_of(np.where(hot, recurring.mixed(keys), h), shards)
        view = memoryview(block.flat)
        rows = []
        for s, at in by_shard(shard):
            text = b"".join([view[a:b] for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)])
            rows.append((s, number, pack(np.frombuffer(text, np.uint8), (end[at] - first[at]).astype(np.uint8), low[at], high[at], np.unique(h[at][hot[at]]))))
        return messages(rows)

    return send


class BlindTrie:
    """Orders byte strings of one length; inner nodes hold a position and one child per byte there."""

    def __init__(self) -> None:
        self.root = None

    def insert(self, text: bytes, value: int) -> None:
        if self.root is None:
            self.root = (text, [value])
            return
        node = self.root
        while isinstance(node, list):  # blind: bytes between the positions are not looked at
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        other = node[0]
        if other == text:
            node[1].append(value)
            return
        common = next(i for i, (a, b) in enumerate(zip(text, other, strict=True)) if a != b)
        above, node = None, self.root
        while isinstance(node, list) and node[0] < common:
            above, node = node, node[1][text[node[0]]]
        leaf = (text, [value])
        if isinstance(node, list) and node[0] == common:
            node[1][text[common]] = leaf
            return
        split = [common, {text[common]: leaf, other[common]: node}]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def groups(self) -> Iterator[list[int]]:
        """Values of equal strings, in ascending order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def _bytes_at(flat: np.ndarray, starts: np.ndarray, depth: int, n: int) -> np.ndarray:
    return flat[starts[:, None] + np.arange(depth, depth + n)]


def deep_shallow(flat: np.ndarray, starts: np.ndarray, depth: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and where groups of equals begin.

    Every suffix must have ``depth`` bytes. Returns positions in ``starts`` and a flag per place.
    """
    n = len(starts)
    order = np.arange(n)
    new = np.zeros(n, bool)
    new[:1] = True
    places = np.arange(n)  # places of the order that lie in groups of two or more
    for at in range(0, shallow, STEP):
        if not len(places):
            break
        group = np.cumsum(new)[places]
        key = _bytes_at(flat, starts[order[places]], at, STEP).view(">u8").reshape(-1).astype(np.uint64)
        local = np.lexsort((key, group)) if at else np.argsort(key, kind="stable")
        order[places] = order[places][local]
        key, group = key[local], group[local]
        new[places[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        last = np.append(new[1:], True)
        places = places[~(new[places] & last[places])]
    # Deep: groups with a common prefix of `shallow` bytes.
    if len(places):
        heads = np.flatnonzero(new[places])
        tails = np.append(heads[1:], len(places))
        rest = _bytes_at(flat, starts[order[places]], shallow, depth - shallow)
        same = np.append(False, (rest[1:] == rest[:-1]).all(axis=1))
        same[heads] = True
        mixed = np.flatnonzero(~np.logical_and.reduceat(same, heads))
        for g in mixed.tolist():
            a, b = int(heads[g]), int(tails[g])
            trie, members, first = BlindTrie(), order[places[a:b]].copy(), int(places[a])
            for k in range(b - a):
                trie.insert(rest[a + k].tobytes(), k)
            at = first
            for equal in trie.groups():
                new[at] = True
                order[at : at + len(equal)] = members[equal]
                at += len(equal)
    return order, new


def _segment_keys(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of segments that lie one after the other, a bounded part at a time."""
    out = []
    ends = starts + lengths
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + recurring.PIECE)))
        lo, hi = int(starts[a]), int(ends[b - 1])
        window = recurring.gram_hashes(_BYTE[flat[lo:hi]], WINDOW)
        head, tail = starts[a:b] - lo, ends[a:b] - lo - WINDOW
        out.append(_keys(window[head], window[tail], tail - head))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _confirm(table: pa.Table) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    known: dict[bytes, int] = {}
    sent, lows, highs, which = [], [], [], []
    for block, data in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
        text, lengths, low, high, hot = unpack(data.as_py())
        view, ends = text.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
        mine = np.array([known.setdefault(view[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64)
        sent.append((block, mine, high, hot))
        which.append(mine)
        lows.append(low)
        highs.append(high)
    low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(low, np.concatenate(which), np.concatenate(lows))
    np.maximum.at(high, np.concatenate(which), np.concatenate(highs))
    lengths = np.array([len(s) for s in known], np.int64)
    flat = np.frombuffer(b"".join(known), np.uint8)
    del known
    seg_start = np.cumsum(lengths) - lengths
    windows = lengths - WINDOW + 1
    segment = np.repeat(np.arange(len(lengths)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, new = deep_shallow(flat, seg_start[segment] + offset)
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(order)))
    first, last = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(low[segment[order]], heads), size)
    last[order] = np.repeat(np.maximum.reduceat(high[segment[order]], heads), size)
    # Runs of windows of a segment that recur with one first document.
    turn = np.append(True, (segment[1:] != segment[:-1]) | (first[1:] != first[:-1]) | ((first[1:] < last[1:]) != (first[:-1] < last[:-1])))
    head = np.flatnonzero(turn)
    tail = np.append(head[1:], len(segment)) - 1
    keep = first[head] < last[head]
    head, tail = head[keep], tail[keep]
    run_segment, run_lo, run_hi, run_first = segment[head], offset[head], offset[tail] + WINDOW, first[head]
    keys = _segment_keys(flat, seg_start, lengths)
    begin = np.searchsorted(run_segment, np.arange(len(lengths)))
    count = np.searchsorted(run_segment, np.arange(len(lengths)), side="right") - begin
    rows = []
    for block, mine, high, hot in sent:
        n = count[mine]
        run = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        run = run[run_first[run] < np.repeat(high, n)]
        if len(run):
            key = keys[run_segment[run]]
            o = np.argsort(key, kind="stable")
            rows.append((shard, block, pack(key[o], run_lo[run][o].astype(np.uint8), run_hi[run][o].astype(np.uint8), run_first[run][o], hot)))
    return messages(rows)


def _remove(key, docs: pa.Table, found: pa.Table) -> pa.Table:
    block = Block(docs)
    edge = np.zeros(len(block.flat) + 1, np.int32)
    if found.num_rows:
        keys, lo, hi, first, hot = (np.concatenate(c) for c in zip(*[unpack(d.as_py()) for d in found.column("data")], strict=True))
        o = np.argsort(keys, kind="stable")
        keys, lo, hi, first = keys[o], lo[o].astype(np.int64), hi[o].astype(np.int64), first[o]
        hot = np.unique(hot)  # the shards return the hot anchors of what they were sent
        for _, doc, start, _, own in block.segments(hot=lambda h: recurring.among(hot, h)):
            a, b = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
            n = b - a
            run = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at, owner = np.repeat(start, n), block.ids[np.repeat(doc, n)]
            ok = first[run] < owner
            np.add.at(edge, at[ok] + lo[run[ok]], 1)
            np.add.at(edge, at[ok] + hi[run[ok]], -1)
    gone = np.cumsum(edge[:-1]) > 0
    out = []
    for doc_id, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
        g = gone[a:b]
        removed = int(np.count_nonzero(g))
        spans = int(g[:1].sum()) + int(np.count_nonzero(g[1:] & ~g[:-1])) if removed else 0
        out.append((doc_id, b - a, removed, spans, block.flat[a:b][~g].tobytes() if removed else block.flat[a:b].tobytes()))
    columns = zip(*out, strict=True) if out else ((), (), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: each text (as UTF-8 bytes) without repeated strings.

    The first document (smallest id) that has a string keeps it; repeats inside one document stay, and so
    do repeats among rows that share an id. Rows with a NULL id are compared with nothing and kept whole.
    NULL texts are empty. Repeated rows stay repeated. Other columns are not read. ``kept`` is binary, as a
    cut may fall inside a character.
    """
    shards = recurring.shard_count(docs, ANCHORS_PER_BYTE)
    units = recurring.blocked(docs)
    recurs = recurring.recurring_anchors(units, _anchors, shards)
    segments = units.groupBy("block").cogroup(recurs.groupBy("block")).applyInArrow(_send_segments(shards), MESSAGE)
    found = segments.groupBy("shard").applyInArrow(_confirm, MESSAGE)
    kept = units.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    no_id = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    whole = no_id.select("doc_id", F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept")
    return kept.unionByName(whole)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``without_repeats``."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
