import numpy as np
import pytest
from llm_data import documents, edge_texts, labels

from tidemark.llm import mixing


def corpus():
    rows, known = [], []
    for i in range(240):
        kind = i % 4
        body = [f"w{(i * 7 + k * k) % 90}" for k in range(20 + i % 30)]
        if kind == 2:
            body = ["JUNK$$"] * 5 + [f"j{(i + k) % 40}" for k in range(20)]
        if kind == 3:
            body[3:3] = ["idiot", "scum"]
        rows.append((1000 + i, " ".join(body)))
        if i % 3:
            known.append((1000 + i, 0 if kind == 2 else 1, 1 if kind == 3 else 0, "x"))
    return rows, known


def test_totals_match_targets(spark):
    rows, known = corpus()
    docs, table = documents(spark, rows), labels(spark, known)
    weights = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    out = mixing.mixed(docs, table, weights).select("doc_id", "n", "p", "rate").collect()
    there = [sum(r.n * r.p[d] for r in out) for d in range(3)]
    total = [sum(r.rate * r.n * r.p[d] for r in out) for d in range(3)]
    target = [there[0] * w / 0.8 for w in weights.values()]
    for d in range(3):
        assert abs(total[d] - target[d]) <= 2e-3 * there[d]
    assert all(r.rate >= 0 and sum(r.p) == pytest.approx(1) for r in out)


def test_held_out_documents_are_told_apart(spark):
    rows, known = corpus()
    labelled = {i for i, *_ in known}
    out = mixing.rates(documents(spark, rows), labels(spark, known)).collect()
    held = [r for r in out if r.doc_id not in labelled]
    right = sum([r.p_clean, r.p_low, r.p_toxic].index(max(r.p_clean, r.p_low, r.p_toxic)) == (0, 0, 1, 2)[(r.doc_id - 1000) % 4] for r in held)
    assert len(held) == 80 and right >= 0.95 * len(held)


def test_edges(spark):
    rows = edge_texts()
    docs = documents(spark, rows)
    known = [(10, 1, 0, "x"), (11, 0, 0, "x"), (12, 1, 1, "x"), (None, 1, 0, "x"), (13, None, None, "x"), (9999, 1, 0, "x")]
    assert mixing.rates(docs, labels(spark, known)).count() == len(rows)
    kept = mixing.selected(docs, labels(spark, known))
    assert kept.columns == docs.columns
    uniform = mixing.rates(docs, labels(spark, [])).collect()
    assert len(uniform) == len(rows) and all(r.p_low == pytest.approx(1 / 3) for r in uniform)
    assert mixing.rates(documents(spark, []), labels(spark, known)).count() == 0
    only = [(i, 1, 0, "x") for i in range(10, 30)]
    assert mixing.rates(docs, labels(spark, only)).count() == len(rows)


def test_step_moves_rates_against_the_error():
    p = np.array([[1.0, 0.0, 0.0], [0.0, 0.5, 0.5]])
    assert mixing.rate(p, [([0.0, 1.0, 0.0], 0.0), ([-0.25, 2.0, 0.0], 0.0)]).tolist() == [1.25, 0.0]
    assert mixing.rate(p, [([-9.0, 0.0, 0.0], 0.0), ([0.0, 0.0, 0.0], 0.5)]).tolist() == [2.5, 1.0]


def bounded_least_squares(n, p, target, scale):
    """Plain projected gradient on all rates at once, for very many rounds."""
    a = (p * n[:, None]).T / scale[:, None]
    r, words = np.ones(len(n)), n.sum()
    size = 1 / np.linalg.eigvalsh((a / n) @ a.T).max()
    for _ in range(30_000):
        r = np.clip(r - size * ((a.T @ (a @ r - target / scale)) / n + mixing.PULL / words * (r - 1)), 0, mixing.MOST_USES)
    return r


@pytest.mark.parametrize("seed", range(4))
def test_fit_reaches_the_least_squares_optimum(spark, seed):
    """Totals and objective against a plain solver, also where targets are out of reach or conflict."""
    rng = np.random.default_rng(seed)
    n = rng.integers(5, 400, 150).astype(float)
    p = rng.dirichlet([(8, 1, 1), (1, 1, 1), (0.3, 0.05, 0.02), (5, 0.02, 0.3)][seed], 150)
    table = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p)], "n double, p array<double>").repartition(3)
    fit = mixing.fit_rates(table)
    r = mixing.rate(p, fit.steps)
    assert r.min() >= 0 and r.max() <= mixing.MOST_USES
    assert np.allclose((r * n) @ p, fit.totals)
    scale = fit.wanted
    value = lambda r: (((((r * n) @ p - fit.reachable) / scale) ** 2).sum() + mixing.PULL * (n @ (r - 1) ** 2) / n.sum()) / 2
    best = bounded_least_squares(n, p, fit.reachable, scale)
    assert value(r) <= value(best) + 2e-3


def test_unreachable_targets_leave_other_documents_alone(spark):
    """A domain of four per cent can not become thirty: it is used up to the bound, and nothing else is moved to make up."""
    rows = [(i, " ".join(f"good{(i + j) % 5}" for j in range(20))) for i in range(2860)] + [(5000 + i, " ".join(f"junk{(i + j) % 5}" for j in range(20))) for i in range(140)]
    known = [(i, 0 if i >= 5000 else 1, 0, "x") for i, _ in rows]
    with pytest.warns(UserWarning, match="wanted shares"):
        out = mixing.selected(documents(spark, rows), labels(spark, known), {"clean": 0.68, "low": 0.3, "toxic": 0.02}).groupBy("doc_id").count().collect()
    times = {r["doc_id"]: r["count"] for r in out}
    assert max(times.values()) <= mixing.MOST_USES
    assert sum(i < 5000 for i in times) >= 2850 and sum(times.get(5000 + i, 0) for i in range(140)) >= 400


@pytest.mark.parametrize("toxic", [0.01, 0.035, 0.08, 0.2])
def test_token_totals_of_selected_rows(spark, toxic):
    """Whatever the incoming shares, the rows that leave have the target shares, cut neither at 0.5 nor at one use."""
    n, low = 4000, 0.035 if toxic < 0.05 else 0.12
    kinds = [2 if i < n * toxic else 1 if i < n * (toxic + low) else 0 for i in range(n)]
    own = [["good"] * 3, ["junk"] * 3, ["scum"] * 3]
    rows = [(i, " ".join(f"{own[k][0]}{(i + j) % 5}" for j in range(20))) for i, k in enumerate(kinds)]
    known = [(i, 0 if k == 1 else 1, 1 if k == 2 else 0, "x") for i, k in enumerate(kinds)]
    out = mixing.selected(documents(spark, rows), labels(spark, known)).select("doc_id").collect()
    total = [sum(kinds[r.doc_id] == d for r in out) for d in range(3)]
    clean = kinds.count(0)
    for d, w in enumerate((0.91, 0.07, 0.02)):
        want = clean * w / 0.91
        assert abs(total[d] - want) <= 5 * want**0.5 + 0.01 * want, (d, total, want)
