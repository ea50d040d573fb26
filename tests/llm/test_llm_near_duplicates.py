import random
from collections import defaultdict

import xxhash
from llm_data import documents, edge_texts

from tidemark.llm import simhash


def fingerprint(text):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Root fingerprint of each, by comparing all pairs."""
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = components(set(prints))
    ids = defaultdict(list)
    for (i, _), f in zip(rows, prints):
        ids[root[f]].append(i)
    smallest = {r: min([i for i in x if i is not None], default=None) for r, x in ids.items()}
    return sorted(((i, f"{f:016x}", smallest[root[f]]) for (i, _), f in zip(rows, prints)), key=str)


def test_against_all_pairs(spark):
    rows = edge_texts()
    got = sorted(map(tuple, simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == expected(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.representatives(documents(spark, [])).count() == 0


def test_masks_cover_every_pair():
    masks = simhash.cover_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


def test_links_are_exact(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(8):
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in prints}
    edges = simhash.close_pairs(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))
    root = components(prints)
    back = {s: f for f, s in signed.items()}
    for a, b in edges.collect():
        assert bin(back[a] ^ back[b]).count("1") <= 2
    group = {r.node: r.root for r in simhash.components(edges).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f, s in signed.items():
        got[group.get(s, s)].add(f)
        want[root[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_document_of_each_group_stays(spark):
    rows = edge_texts()
    docs = documents(spark, rows)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    groups = {c for *_, c in expected(rows)}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c for c in groups if c is not None)
