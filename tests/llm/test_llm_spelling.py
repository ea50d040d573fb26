"""Spelling variants by pivotal grams against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_data import DOCS, documents, edge_texts

from tidemark.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute_force(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_documents(spark):
    rng = random.Random(6)
    stems = ["Ortografía", "hyphen", "naïveté", "aaaaa", "ababab", "Übergröße", "letter"]

    def slip(w):
        i, x = rng.randrange(len(w)), rng.choice("abéÀ×")
        return rng.choice([w, w, w[:i] + w[i + 1 :], w[:i] + x + w[i:], w[:i] + x + w[i + 1 :]])

    rows = edge_texts() + [(1000 + i, " ".join(slip(slip(rng.choice(stems))) for _ in range(200))) for i in range(60)]
    found = result(spelling.digest(documents(spark, rows)))
    assert found == brute_force(counts(rows)) and sum(r[1] is not None for r in found) > 100


def test_empty_table(spark):
    assert spelling.digest(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé🙂"])
def test_near_words_of_any_alphabet(spark, letters):
    """Words of few letters repeat their grams, so that grams tie and lie more than once in a word."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(5, 8))): rng.randint(1, 40) for _ in range(250)} | {"a" * 40: 3, "a" * 41: 9}
    assert result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_force(words)


def test_chains_of_forms(spark):
    """The root lies many forms away."""
    words = {"a" * (5 + i): 1 << i for i in range(40)}
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.root for r in found} == {"a" * 44}


def test_pivots_are_the_cheapest_pair():
    rng = random.Random(9)
    for _ in range(300):
        places = rng.sample(range(12), rng.randint(3, 6))
        prefix = [(rng.randint(1, 9), "xy", p) for p in places]
        chosen = spelling.pivots(prefix)
        pairs = [a[0] + b[0] for a in prefix for b in prefix if b[2] - a[2] >= 2]
        assert abs(chosen[0][2] - chosen[1][2]) >= 2 and chosen[0][0] + chosen[1][0] == min(pairs)
