import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_data import documents, edge_texts, words

from tidemark.llm import common, phrases, recurring, suffixes


def word_repeats(rows, n=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def byte_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            if i is not None:
                first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if i is not None and first[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_phrases_against_plain_python(spark):
    for seed in (1, 2):
        rows = edge_texts(seed)
        assert sorted(map(tuple, phrases.digest(documents(spark, rows)).collect()), key=str) == word_repeats(rows)


def test_bytes_against_plain_python(spark):
    for seed in (1, 2):
        rows = edge_texts(seed)
        assert sorted(map(tuple, suffixes.digest(documents(spark, rows)).collect()), key=str) == byte_repeats(rows)


def test_hot_anchors_change_no_result(spark, monkeypatch):
    """All recurring anchors hot, or only those of many runs."""
    rows = edge_texts()
    for most in (0, 3):
        monkeypatch.setattr(recurring, "HOT_RUNS", most)
        assert sorted(map(tuple, phrases.digest(documents(spark, rows)).collect()), key=str) == word_repeats(rows)
        assert sorted(map(tuple, suffixes.digest(documents(spark, rows)).collect()), key=str) == byte_repeats(rows)


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_one_line_in_a_third_of_all_documents_fills_no_shard(operator, monkeypatch):
    """Largest shard against the median, at two sizes: surroundings are random, so edges are all distinct."""
    monkeypatch.setattr(recurring, "HOT_RUNS", 50)
    rng = random.Random(5)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    shards, blocks = 16, 4
    for n in (600, 2400):
        def around():
            return " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
        rows = [(i, f"{around()} {line if i % 3 == 0 else ''} {around()}") for i in range(n)]
        tables = []
        for b in range(blocks):
            mine = [r for r in rows if r[0] % blocks == b]
            tables.append(pa.table({"block": pa.array([b] * len(mine), pa.int32()), "doc_id": pa.array([i for i, _ in mine], pa.int64()), "text": pa.array([t for _, t in mine])}))
        parts = [operator._anchors(t) for t in tables]
        _, fp = recurring.shard_of(np.concatenate([h for h, _ in parts]), shards)
        shard, _ = recurring.shard_of(np.concatenate([h for h, _ in parts]), shards)
        key, count = np.unique(shard << 31 | fp, return_counts=True)
        several = key[count > 1]
        answers = []
        for s in range(shards):
            of = several[several >> 31 == s]
            values = (of & ((1 << 31) - 1)).astype(np.uint32)
            hot = count[np.searchsorted(key, of)] > recurring.HOT_RUNS
            answers.append((s, 0, recurring.pack(np.diff(values, prepend=np.uint32(0)), hot)))
        wanted = recurring.messages(answers)
        size = np.zeros(shards, np.int64)
        for t in tables:
            for row in operator._send_segments(shards)(None, t, wanted).to_pylist():
                size[row["shard"]] += len(recurring.unpack(row["data"])[0])
        assert size.max() <= 4 * np.median(size), (n, size.tolist())


def test_empty_table(spark):
    assert phrases.digest(documents(spark, [])).count() == 0
    assert suffixes.digest(documents(spark, [])).count() == 0


def test_pieces_of_a_long_text(monkeypatch):
    """Cutting a text into pieces changes segments, never results."""
    rows = [(i, t) for i, t in edge_texts() if i is not None]
    table = pa.table({"block": pa.array([0] * len(rows), pa.int32()), "doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t or "" for _, t in rows])})
    want = byte_repeats(rows)
    for piece in (1 << 20, 700, 64):
        monkeypatch.setattr(recurring, "PIECE", piece)
        # Every anchor counts as recurring: more candidates, the same answer.
        block = suffixes.Block(table)
        h = np.concatenate([x[0] for x in block.segments()])
        shard, fp = recurring.shard_of(h, 1)
        wanted = recurring.messages([(0, 0, recurring.pack_sorted(np.unique(fp)))])
        sent = suffixes._send_segments(1)(None, table, wanted)
        result = suffixes._remove(None, table, suffixes._confirm(sent)).to_pylist()
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in result), key=str)
        assert got == want


def test_deep_shallow_order():
    rng = random.Random(3)
    text = "".join(rng.choices("ab", k=400)) + "a" * 300 + "".join(rng.choices("abc", k=300)) * 2
    flat = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(flat) - 49)
    for shallow in (8, 16, 40):
        order, new = suffixes.deep_shallow(flat, starts, 50, shallow)
        cut = [text[s : s + 50] for s in starts[order]]
        assert sorted(order.tolist()) == starts.tolist() and cut == sorted(cut)
        assert new.tolist() == [k == 0 or cut[k] != cut[k - 1] for k in range(len(cut))]


def test_blind_trie():
    rng = random.Random(4)
    texts = ["".join(rng.choices("xyz", k=6)).encode() for _ in range(300)]
    trie = suffixes.BlindTrie()
    for k, t in enumerate(texts):
        trie.insert(t, k)
    groups = [sorted({texts[k] for k in g}) for g in trie.groups()]
    assert [g[0] for g in groups] == sorted(set(texts)) and all(len(g) == 1 for g in groups)


def test_automaton_finds_every_occurrence():
    rng = random.Random(6)
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(500)]
    sought = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(2, 5))) for _ in range(40)}
    machine = phrases.Automaton([(b" ".join(s), k) for k, s in enumerate(sorted(sought))])
    want = {(i, i + len(s), k) for k, s in enumerate(sorted(sought)) for i in range(len(text)) if tuple(text[i : i + len(s)]) == s}
    assert set(machine.find(text)) == want
    assert list(machine.find([b"z"] * 20)) == []


def test_blocks_of_a_table_of_unknown_size(spark, monkeypatch):
    monkeypatch.setattr(common, "input_bytes", lambda df: 1 << 62)
    docs = documents(spark, [(i, "x" * 1000) for i in range(50)] + [(None, None)])
    assert common.partitions_for(docs, 0.001, at_least=2) == 24  # 50,000 bytes, taken as half in Parquet
    assert common.partitions_for(docs.select("doc_id"), 0.001, at_least=2) == 2
    assert common.partitions_for(docs.where("doc_id < 0"), 0.001, at_least=2) == 2


def test_packing():
    values = np.array([3, 3, 9, 2**32 - 1], np.uint32)
    assert recurring.unpack_sorted(recurring.pack_sorted(values)).tolist() == values.tolist()
    a, b, c = recurring.unpack(recurring.pack(np.zeros(0, np.int64), np.arange(5, dtype=np.int64) - 2, np.frombuffer(b"xyz", np.uint8)))
    assert (a.tolist(), b.tolist(), c.tobytes()) == ([], [-2, -1, 0, 1, 2], b"xyz")


def test_gram_hashes_depend_on_the_gram_only():
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 4, 3000).astype(np.uint64)
    for size in (1, 2, 5, 6, 24, 50):
        h = recurring.gram_hashes(unit, size)
        assert len(h) == len(unit) - size + 1
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(unit[i : i + size].tobytes(), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 1000, 200)
    for width in (1, 2, 7, 8, 27):
        assert recurring.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
