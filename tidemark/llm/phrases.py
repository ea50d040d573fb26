"""Repeated phrases by sharded Aho-Corasick automata.

A window is 13 consecutive words. A word goes if a window over it also starts in a document with a
smaller id. Candidates come from anchors (see ``recurring``): grams of six words, so that a window names
the smallest of eight. A shard confirms which windows of its segments recur, word by word, and tells each
block which passages of it do and the first document of each. A block compiles its passages into an
automaton and streams all its documents through it to locate every occurrence.

The automaton reads three letters for a word (base 64, each place with letters of its own), so that no
node has more than 64 children: child lists are searched linearly. Words not in any passage are a letter
that matches nothing. Memory is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import recurring
from tidemark.llm.recurring import MESSAGE, Wanted, by_shard, messages, pack, unpack

WINDOW = 13
GRAM = 6
GRAMS = WINDOW - GRAM + 1
ANCHORS_PER_BYTE = 0.04
_MEMO_ROWS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _MEMO_ROWS:
            self[word] = h
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes.split cuts at exactly the separators \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _segments(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Pieces of a block: anchor of each segment, its document's id, the piece's words, first and end word."""
    ids = table.column("doc_id").to_numpy()
    words: list[bytes] = []
    owner: list[np.ndarray] = []

    def piece():
        unit = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        anchor = recurring.sliding_min(recurring.gram_hashes(unit, GRAM), GRAMS)
        own = np.concatenate(owner)[: len(anchor)]
        heads, tails = recurring.runs(anchor, own, GRAMS)
        return anchor[heads], ids[own[heads]], words, heads, tails + WINDOW

    for i, text in enumerate(table.column("text")):
        tokens = words_of(text.as_py())
        if len(tokens) >= WINDOW:
            words += tokens
            own = np.full(len(tokens), i, np.int64)
            own[len(tokens) - WINDOW + 1 :] = -1
            owner.append(own)
        if len(words) > recurring.PIECE // 8:
            yield piece()
            words, owner = [], []
    if words:
        yield piece()


def _anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [(h, ids) for h, ids, *_ in _segments(table)]
    return (np.concatenate([h for h, _ in parts]), np.concatenate([i for _, i in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _send_segments(shards: int):
    def send(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows or not wanted.num_rows:
            return messages([])
        block = docs.column("block")[0].as_py()
        want = Wanted(wanted, shards)
        found: dict[bytes, list] = {}  # segment -> anchor, smallest and largest id
        for h, ids, words, first, end in _segments(docs):
            hot = want.hot(h)
            for k in np.flatnonzero(want(h)).tolist():
                doc, a, b = int(ids[k]), int(first[k]), int(end[k])
                # A hot anchor's windows go one by one, each to the shard of its own hash.
                for a, b in [(i, i + WINDOW) for i in range(a, b - WINDOW + 1)] if hot[k] else [(a, b)]:
                    segment = b" ".join(words[a:b])
                    entry = found.get(segment)
                    if entry is None:
                        found[segment] = [xxhash.xxh64_intdigest(segment) if hot[k] else int(h[k]), doc, doc]
                    else:
                        entry[1], entry[2] = min(entry[1], doc), max(entry[2], doc)
        texts = list(found)
        rows = np.array([e[1:] for e in found.values()], np.int64).reshape(-1, 2)
        shard, _ = recurring.shard_of(np.array([e[0] for e in found.values()], np.uint64), shards)
        return messages([
            (s, block, pack(np.frombuffer(b"\n".join(texts[i] for i in at.tolist()), np.uint8), rows[at, 0], rows[at, 1]))
            for s, at in by_shard(shard)
        ])

    return send


def _confirm(table: pa.Table) -> pa.Table:
    """Which windows of a shard's segments recur, and to each block its passages of them."""
    shard = table.column("shard")[0].as_py()
    sent = []
    span: dict[bytes, list[int]] = {}  # segment -> smallest and largest id anywhere
    for block, data in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
        text, low, high = unpack(data.as_py())
        segments = text.tobytes().split(b"\n")
        sent.append((block, segments, high.tolist()))
        for segment, lo, hi in zip(segments, low.tolist(), high.tolist(), strict=True):
            known = span.get(segment)
            if known is None:
                span[segment] = [lo, hi]
            else:
                known[0], known[1] = min(known[0], lo), max(known[1], hi)
    first: dict[bytes, list[int]] = {}  # window -> smallest and largest id
    cut = {}
    for segment, (lo, hi) in span.items():
        words = segment.split()
        cut[segment] = windows = [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        for w in windows:
            known = first.get(w)
            if known is None:
                first[w] = [lo, hi]
            else:
                known[0], known[1] = min(known[0], lo), max(known[1], hi)
    passages: dict[bytes, list[tuple[bytes, int]]] = {}
    for segment, windows in cut.items():
        words = segment.split()
        out, i = [], 0
        while i < len(windows):
            lo, hi = first[windows[i]]
            j = i + 1
            while j < len(windows) and first[windows[j]][0] == lo and first[windows[j]][1] > lo:
                j += 1
            if lo < hi:
                out.append((b" ".join(words[i : j - 1 + WINDOW]), lo))
            i = j
        passages[segment] = out
    rows = []
    for block, segments, high in sent:
        mine = [p for segment, hi in zip(segments, high, strict=True) for p in passages[segment] if p[1] < hi]
        if mine:
            rows.append((shard, block, pack(np.frombuffer(b"\n".join(t for t, _ in mine), np.uint8), np.array([d for _, d in mine], np.int64))))
    return messages(rows)


class Automaton:
    """Passages (words joined by one space) with a value each; finds every occurrence in a word list."""

    def __init__(self, passages: list[tuple[bytes, int]]):
        self.codes: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()
        for text, value in passages:
            words = text.split()
            self.machine.add_word("".join(self._code(w) for w in words), (len(words), value))
        self.machine.make_automaton()

    def _code(self, word: bytes) -> str:
        code = self.codes.get(word)
        if code is None:
            n = len(self.codes)
            high = n >> 12  # letters of the last place grow with the vocabulary
            code = self.codes[word] = chr(0x100 + (n & 63)) + chr(0x140 + (n >> 6 & 63)) + chr(0x180 + high)
        return code

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``start, end, value`` of every occurrence, in words."""
        get = self.codes.get
        for last, (n, value) in self.machine.iter("".join([get(w, "\0\0\0") for w in words])):
            end = last // 3 + 1
            yield end - n, end, value


def _locate(key, docs: pa.Table, passages: pa.Table) -> pa.Table:
    """Stream the documents of a block through its automaton; drop what earlier documents have."""
    mine = []
    for data in passages.column("data"):
        text, first = unpack(data.as_py())
        mine += zip(text.tobytes().split(b"\n"), first.tolist(), strict=True)
    automaton = Automaton(mine) if mine else None
    out = []
    for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text"), strict=True):
        words = words_of(text.as_py())
        kept = words
        if automaton and len(words) >= WINDOW:
            edge = [0] * (len(words) + 1)
            hit = False
            for start, end, first in automaton.find(words):
                if first < doc_id:
                    edge[start] += 1
                    edge[end] -= 1
                    hit = True
            if hit:
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
    columns = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each document without repeated passages, words joined by one space.

    The first document (smallest id) that has a passage keeps it; repeats inside one document stay, and so
    do repeats among rows that share an id. Rows with a NULL id are compared with nothing and kept whole.
    NULL and blank texts have no words. Repeated rows stay repeated. Other columns are not read.
    """
    shards = recurring.shard_count(docs, ANCHORS_PER_BYTE)
    units = recurring.blocked(docs)
    recurs = recurring.recurring_anchors(units, _anchors, shards)
    segments = units.groupBy("block").cogroup(recurs.groupBy("block")).applyInArrow(_send_segments(shards), MESSAGE)
    passages = segments.groupBy("shard").applyInArrow(_confirm, MESSAGE)
    located = units.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(_locate, "doc_id long, n_words long, n_removed long, kept string")
    no_id = docs.where("doc_id IS NULL").select(
        F.col("doc_id").cast("long"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), 0).alias("w")
    ).select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("w", " ").alias("kept"))
    return located.unionByName(no_id)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of ``without_repeats``."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


REPEATS_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
c AS (
  SELECT DISTINCT doc_id, i + o AS p
  FROM (SELECT g.doc_id, g.i, unnest(range(0, 13)) AS o FROM g JOIN f USING (s) WHERE f.first < g.doc_id)
), p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
k AS (
  SELECT p.doc_id, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN p.word END, ' ' ORDER BY p.p) AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
