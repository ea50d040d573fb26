"""Exact duplicates: Patricia tries, spilling, owners, against plain Python."""

import hashlib
import random
import re

from llm_data import DOCS, documents, edge_texts

from tidemark.llm import exact


def brute_force(rows):
    found = {}
    plain = [re.sub("[ \t\n\x0b\x0c\r]", "", t or "") for _, t in rows]
    order = [(-len(t or ""), i is None, i or 0, n) for n, (i, t) in enumerate(rows)]
    for p, o in zip(plain, order, strict=True):
        found.setdefault(p, []).append(o)
    return sorted((str((i, rows[min(found[p])[3]][0], len(found[p]), hashlib.sha256(p.encode()).hexdigest())) for (i, _), p in zip(rows, plain, strict=True)))


def result(frame):
    out = frame.collect()
    for sha, n in {r.text_sha256: r.group_size for r in out}.items():
        assert [r.kept for r in out if r.text_sha256 == sha].count(True) == 1 and sum(r.text_sha256 == sha for r in out) == n
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in out)


def test_awkward_rows(spark):
    rows = edge_texts() + [(90, "a b"), (91, "ab "), (92, "ab"), (93, "a\xa0b"), (89, "ab\n"), (94, "é"), (95, "é"), (96, "\r\n")]
    assert result(exact.digest(documents(spark, rows).repartition(5))) == brute_force(rows)


def test_empty_table(spark):
    assert exact.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_small_budgets_change_nothing(spark, monkeypatch):
    """Tries that are emptied all the time, spill, and merge strings of many classes in parts."""
    rng = random.Random(3)
    stems = ["", "x" * 2000, "shared beginning " * 40]
    rows = [(i, rng.choice(stems) + " ".join(rng.choices(["aa", "bb", "c"], k=rng.randint(0, 4)))) for i in range(3000)]
    docs = documents(spark, rows).repartition(6)
    plain = exact.groups
    monkeypatch.setattr(exact, "groups", lambda d: plain(d, local_bytes=3000, trie_bytes=20_000, fan=3))
    assert result(exact.digest(docs)) == brute_force(rows)


def test_trie_spills_by_subtree(tmp_path):
    rng = random.Random(5)
    keys = [rng.choice([b"", b"p" * 500, b"pp"]) + bytes(rng.choices(b"abcd", k=rng.randint(0, 6))) for _ in range(4000)]
    expected = {}
    for n, key in enumerate(keys):
        expected.setdefault(key, []).append(n)

    class Context:
        partitionId = taskAttemptId = staticmethod(lambda: 1)

    exact.attempt_name.__globals__["TaskContext"], kept = type("T", (), {"get": Context}), exact.attempt_name.__globals__["TaskContext"]
    try:
        found = {}
        for key, item in exact.merged(((k, (0, False, n, 0, n), 1, [n]) for n, k in enumerate(keys)), 30_000, str(tmp_path)):
            assert key not in found
            found[key] = sorted(item.classes)
            assert item.owner[4] == min(item.classes) and item.rows == len(item.classes)
    finally:
        exact.attempt_name.__globals__["TaskContext"] = kept
    assert found == expected
    trie = exact.Trie(30_000, str(tmp_path))
    trie_max = 0
    for n, key in enumerate(bytes([a, b, c]) * 50 for a in range(8) for b in range(8) for c in range(8)):
        trie.add(key, (0, False, n, 0, n), 1, [n])
        trie_max = max(trie_max, trie.size)
    assert trie.spills and trie_max < 33_000


def test_distinct_documents(spark):
    rows = edge_texts()
    docs = documents(spark, rows)
    out = exact.distinct_documents(docs)
    assert out.columns == docs.columns
    plain = lambda t: re.sub("[ \t\n\x0b\x0c\r]", "", t or "")
    assert sorted(plain(r.text) for r in out.collect()) == sorted({plain(t) for _, t in rows})
