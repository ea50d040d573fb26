import random
from collections import defaultdict

import corpus_pipeline
import pytest
from llm_data import documents, edge_texts
from oracle import TESTDATA
from pyspark.sql import functions as F

from tidemark.llm import jaccard, simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(texts):
    """Index of the first text of each text's component, by comparing all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def kept_by(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect())


def near_texts():
    rng = random.Random(3)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    texts = []
    for changes in range(16):  # similarities around 0.8
        base = fresh(300)
        texts.append(" ".join(base))
        for at in rng.sample(range(300), changes):
            base[at] = fresh(1)[0].upper()
        texts.append(" ".join(base))
    chain = fresh(200)  # each near to the next only
    for k in range(12):
        texts.append(" ".join(chain))
        chain[k * 15 : k * 15 + 10] = fresh(10)
    return texts


def test_groups_against_all_pairs(spark):
    rows = list(enumerate(near_texts()))
    assert kept_by(spark, rows) == sorted(set(groups([t for _, t in rows])))


def test_edge_rows(spark):
    rows = [r for r in edge_texts() if r[0] is not None]
    first = groups([t for _, t in rows])
    smallest = defaultdict(list)
    for (i, _), g in zip(rows, first):
        smallest[g].append(i)
    assert kept_by(spark, rows) == sorted(map(min, smallest.values()))
    assert kept_by(spark, []) == []


@pytest.mark.parametrize("hub_yield", [1, 20, 10**9])
def test_hubs_and_prefixes_find_what_all_pairs_do(spark, monkeypatch, hub_yield):
    texts = near_texts()
    rng = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    for _ in range(40):  # near to the base and not always to each other
        copy = list(base)
        for at in rng.sample(range(200), 5):
            copy[at] = f"c{rng.getrandbits(40)}"
        texts.append(" ".join(copy))
    passage = [f"p{k}" for k in range(80)]
    for k in range(60):  # a passage that is a half to nearly all of many texts of their own
        own = [f"o{rng.getrandbits(40)}" for _ in range(8 + k)]
        texts.append(" ".join(rng.choice([own + passage, passage + own])))
    monkeypatch.setattr(jaccard, "HUB_YIELD", hub_yield)
    assert kept_by(spark, list(enumerate(texts))) == sorted(set(groups(texts)))


def test_prefix_pairs_miss_none_and_skip_a_shared_passage(spark):
    rng = random.Random(8)
    passage = list(range(60))
    sets = []
    for k in range(150):  # unlike texts with one passage: similarities of up to 0.75
        sets.append(set(passage) | {rng.getrandbits(40) for _ in range(10 + k % 40)})
    for k in range(60):  # near copies of all degrees and sizes
        base = {rng.getrandbits(40) for _ in range(rng.choice([1, 4, 9, 10, 45, 90]))}
        sets += [base, set(list(base)[: max(1, int(len(base) * rng.uniform(0.7, 1)))]) | {rng.getrandbits(40) for _ in range(rng.randint(0, len(base) // 8))}]
    frame = spark.createDataFrame([(i, i, sorted(s)) for i, s in enumerate(sets)], "node long, root long, set array<long>")
    found = {(r.a, r.b) for r in jaccard.prefix_pairs(frame).collect()}
    alike = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if (len(sets[i]), i) > (len(sets[j]), j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert alike <= found and len(found) < 3 * len(sets)
    same = frame.withColumn("root", frame.root * 0)
    assert jaccard.prefix_pairs(same).isEmpty()


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id IS NOT NULL").orderBy("doc_id").collect()][:800]
    first = groups([t for _, t in rows])
    assert kept_by(spark, rows) == sorted({rows[g][0] for g in first})


def test_fingerprints_link_what_shares_no_band(spark, monkeypatch):
    """The stage begins with the covering tables, and the exact check decides what they bring together."""
    rng = random.Random(5)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    texts = []
    for changes in range(8):
        base = fresh(1500)
        texts.append(" ".join(base))
        for at in rng.sample(range(1500), changes):
            base[at] = fresh(1)[0]
        texts.append(" ".join(base))
    texts += ["two unlike", "short texts", "", None]
    rows = list(enumerate(texts))
    prints = [simhash.fingerprint_of(jaccard.shingles(t)) for t in texts]
    close = [bin((prints[i] ^ prints[i + 1]) & (2**64 - 1)).count("1") <= 2 for i in range(0, 16, 2)]
    assert 2 <= sum(close[1:]) < 7 and close[0]  # some near copies are within two bits, some are not

    found = jaccard.signatures

    def apart(docs):
        """No text shares a band with another; two unlike ones have one fingerprint."""
        mark = F.array(F.col("node"), F.col("node") + 1)
        return found(docs).withColumn("bands", mark).withColumn("fp", F.when(F.col("doc_id").isin(16, 17), 0).otherwise(F.col("fp")))

    monkeypatch.setattr(jaccard, "signatures", apart)
    kept = kept_by(spark, rows)
    assert kept == sorted([*range(0, 16, 2), *(2 * k + 1 for k in range(8) if not close[k]), 16, 17, 18])


def test_fingerprint_pairs_are_linear(spark):
    sizes = {0: 5, 1: 7, 3: 9}
    nodes = [(1000 * fp + i, n, fp) for fp, n in sizes.items() for i in range(n)] + [(7, 9, 1 << 40), (8, 9, -1)]
    pairs = {(r.a, r.b) for r in jaccard.fingerprint_pairs(spark.createDataFrame(nodes, "node long, size long, fp long")).collect()}
    own = {(1000 * fp + i, 1000 * fp) for fp, n in sizes.items() for i in range(1, n)}
    assert own <= pairs and {frozenset(p) for p in pairs - own} <= {frozenset(p) for p in [(0, 1000), (0, 3000), (1000, 3000), (0, 7), (7, 1000)]}
    assert {(7, 0)} <= pairs and not any(8 in p for p in pairs)
