import math
import re
from collections import Counter

import pytest
import xxhash
from llm_data import documents, edge_texts, labels, words

from tidemark.llm import quality

LABELS = [(10, 1, 0, "x"), (11, 1, 0, "x"), (12, 0, 0, "x"), (13, 1, 1, "x"), (13, 1, 0, "x"), (14, 1, None, "x"), (None, 1, 0, "x"), (999, 1, 0, "x"), (15, None, 0, "x")]


def base(text):
    text = text or ""
    w = words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def bins(text, m):
    w = [x.encode() for x in words(text)]
    one = [xxhash.xxh64_intdigest(x, 42) for x in w]
    two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, w[1:])]
    signed = [h - (1 << 64) if h >> 63 else h for h in one + two]
    return [h % m for h in signed]


def ratios(rows, trusted, m):
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(bins(t, m))
        if i in trusted:
            good.update(bins(t, m))
    a, b = sum(good.values()) + m, sum(raw.values()) + m
    return [math.log((good[k] + 1) / a) - math.log((raw[k] + 1) / b) for k in range(m)]


def test_against_plain_python(spark):
    rows, m = edge_texts(), 256
    got = quality.judged(documents(spark, rows), labels(spark, LABELS), bins=m).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(rows)
    table = ratios(rows, {10, 11, 14}, m)
    for r in got:
        b = bins(r.text, m)
        score = sum(table[k] for k in b) / len(b) if b else 0.0
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert r.score == pytest.approx(score, abs=1e-5)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_without_labels_or_rows(spark):
    docs = documents(spark, edge_texts())
    got = quality.judged(docs, labels(spark, [])).select("quality.*").collect()
    assert all(r.score == 0 and r.kept != r.base_failed for r in got)
    assert quality.judged(documents(spark, []), labels(spark, LABELS)).count() == 0


def test_repeats_overlap(spark):
    text = "a b c d e a b c d e a b c d e x y z w v"
    r = quality.judged(documents(spark, [(1, text)]), labels(spark, [])).select("quality.*").first()
    assert r.n_repeat_words == base(text)[4] == 15 and r.base_failed
    assert re.fullmatch(r"\d+", str(r.n_words))
