from llm_data import documents, edge_texts, words

from tidemark.llm import decontamination as d


def shingles(text):
    w = words((text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "item_id long, text string, h string, rk string")


def expected(rows, items):
    parts = {}
    for i, t in items:
        if i is not None:
            parts.setdefault(i, set()).update(shingles(t))
    out = {}
    for doc, t in rows:
        s = shingles(t)
        for i, p in parts.items():
            shared = len(s & p)
            if p and shared * 1000 >= 800 * len(p):
                out[doc, i] = max(out.get((doc, i), 0), shared)
    return {(doc, i, n, len(parts[i]), round(n / len(parts[i]), 6)) for (doc, i), n in out.items()}


def test_against_sets(spark):
    rows = edge_texts()
    text = dict(rows)
    items = [(i, " ".join(words(text[75])[a : a + 20])) for i, a in enumerate(range(10))]
    w = words(text[73])
    items += [(20 + k, " ".join(w[100 * k : 100 * k + 12] + ["zz"] * k)) for k in range(8)]  # part of it elsewhere
    items += [(40, None), (41, ""), (42, "one"), (43, "two WORDS"), (None, text[75]), (44, text[75]), (44, text[75]), (45, " ".join(w[:300]))]
    items += [(46, " ".join(w[:40])), (46, " ".join(w[30:60]))]
    docs = documents(spark, rows)
    got = {tuple(r) for r in d.leaks(docs, items_table(spark, items)).collect()}
    assert got == expected(rows, items)
    bad = {(doc) for doc, *_ in got}
    kept = d.clean(docs, items_table(spark, items))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if i not in bad or not any(e[0] == i for e in expected([(i, t)], items)))


def test_empty_tables(spark):
    docs = documents(spark, edge_texts())
    assert d.leaks(docs, items_table(spark, [])).count() == 0
    assert d.clean(docs, items_table(spark, [])).count() == docs.count()
    assert d.leaks(documents(spark, []), items_table(spark, [(1, "a b c d e f")])).count() == 0


def test_sketch_is_longer_than_what_may_be_missing(spark):
    items = items_table(spark, [(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in range(1, 70)])
    for item, need, k in d.sketches(items).groupBy("item_id", "need").count().collect():
        assert need == -(-item * 8 // 10) and (k == item or k > item - need)
