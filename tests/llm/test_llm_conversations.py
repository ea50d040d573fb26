"""Prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import conversations as ct

SCHEMA = "conv_id long, turn long, role string, text string, k1 long, depth string, n long"


def brute_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = own_saved + sum(saved[k] for k in kids.get(p, []))
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 3) for r in rows], SCHEMA)


def awkward():
    rng = random.Random(2)
    rows = [(None, 0, "user", "no conversation"), (None, None, None, None)]
    openings = [("user", "hi"), ("assistant", "hello é"), ("user", ""), (None, "hi")]
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        for t in range(rng.randint(1, 12)):
            role, text = rng.choice(openings) if rng.random() < 0.8 else ("user", f"said {rng.randint(0, 9)}")
            rows.append((c, None if rng.random() < 0.1 else t, role, None if rng.random() < 0.1 else text))
    for c in range(200, 320):
        rows += [(c, t, "user", f"copy {t}") for t in range(12)]
    for c in range(400, 440):
        rows += [(c, t, "user", f"copy {t}" if t < 20 else f"own {c} {t}") for t in range(24)]
    rows += [(501, t, "user", "a long one " + str(t % 3)) for t in range(300)] + [(502, 0, "x", "y"), (502, 0, "x", "y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("unit_turns", [20_000, 50, 1])
def test_against_brute_force(spark, unit_turns, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(ct, "UNIT_TURNS", unit_turns)
    monkeypatch.setattr(ct, "SHARD_TURNS", 500)
    nodes = ct.trie_nodes(ct.rebuilt(ct.numbered(table(spark, rows))), unit_turns)
    assert sorted((tuple(r) for r in nodes.collect()), key=str) == brute_force(rows)


def test_empty_table_and_turnless(spark):
    assert ct.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(alone, 0, "user", "taken away")]
    assert [tuple(r) for r in ct.digest(table(spark, rows)).collect()] == brute_force(rows)


def test_double_array_follows_every_sequence():
    rng = random.Random(4)
    sequences = [[rng.randint(1, 400) for _ in range(rng.randint(1, 9))] for _ in range(800)] + [[t] for t in range(1, 401)]
    lengths = np.array([len(s) for s in sequences])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    trie = ct.pack(starts, lengths, np.array(sum(sequences, [])))
    prefixes = {tuple(s[:d]) for s in sequences for d in range(1, len(s) + 1)}
    assert int((trie.check >= 0).sum()) == len(prefixes) + 1 and trie.end < 2 * len(prefixes)
    reached = {}
    for s in sequences:
        node = 0
        for d, turn in enumerate(s, 1):
            node = int(trie.child(np.array([node]), np.array([turn]))[0])
            assert reached.setdefault(node, tuple(s[:d])) == tuple(s[:d])
    assert set(reached.values()) == prefixes
