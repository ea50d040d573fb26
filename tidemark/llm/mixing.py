"""Mixing documents to target domain weights with soft domain membership.

A classifier that is trained on the label table gives every document a posterior over domains. A classifier that is trained on the label table gives every document a posterior over domains. Each
document gets one nonnegative rate (how often it is used), at most ``MOST_USES``. With ``n`` the words of a document and ``p``
its posterior, the expected tokens of domain *d* are the sum of ``rate * n * p[d]``; projected gradient
descent moves the rates until these totals match the targets in the relative least-squares sense, with a
small pull of every rate towards 1.

The problem has one unknown per document and stays distributed: a round needs only the domain totals,
one aggregation of a few numbers. In coordinates scaled by ``n`` a gradient step is
``rate <- clip(rate - step . p - pull * (rate - 1))`` with one small vector ``step`` for all documents, so the
rates of any round are a function of the posterior and the steps so far. Only steps are kept on the driver.
A round measures several steps at once and takes the best. The plain gradient step by the inverse of the
largest curvature is one of them, so the objective falls in every round and the fit can not run away. The
others speed it up: at the optimum the rates are ``clip(1 - m . p)``, a projected step from rate 1 whose
vector ``m`` maximises a concave dual of a few variables, so the search also follows that dual by damped
Newton steps, and a point of it becomes the iterate as soon as it has the lower objective.

A target is *reachable* if raising every document towards ``MOST_USES`` in proportion to its posterior brings it
about. Beyond that the noise of small posteriors would decide who is raised, so such a target is lowered to
what is reachable, with a warning.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialised, row_key

DOMAINS = ("clean", "low", "toxic")
# Wanted shares of all tokens; the first domain is used in full and sets the scale.
WEIGHTS = {"clean": 0.91, "low": 0.07, "toxic": 0.02}
# Bound of the labelled sample that the classifier is fitted on; everything else covers all rows.
SAMPLE_ROWS = 8000
FEATURES = 1 << 17
PREFIXES = (4, 5)  # bytes
# Features that fewer sampled documents have say nothing about others.
MIN_DOCS = 20
STEPS = 80
REGULARISATION = 5.0
RATE = 0.2
# No document is used more often.
MOST_USES = 4
PULL = 1e-3
# The fit ends when every total is within TOLERANCE of its target, or when IDLE rounds in a row lower the objective by
# less than STANDSTILL of it.
TOLERANCE, STANDSTILL, IDLE = 1e-3, 1e-3, 4
# Shares of the largest curvature that are added to it, so that steps stay bounded where few rates are free.
RIDGES = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
SEED = 17
_EDGE = b".,;:!?\"'()"
_MEMO_ROWS = 500_000


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic if any label row says so, else low or clean by quality; NULLs label nothing."""
    per_doc = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).when(F.col("q") == 1, 0)
    return per_doc.select("doc_id", domain.cast("int").alias("domain")).where("domain IS NOT NULL")


class _Places(dict):
    """Features of a word: hashes of its lower-case form without outer punctuation, and of how it begins."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        core = word.lower().strip(_EDGE)
        forms = [core, *(core[:n] + b"*" for n in PREFIXES if len(core) > n)]
        places = tuple(xxhash.xxh32_intdigest(f) % FEATURES for f in forms)
        if len(self) < _MEMO_ROWS:
            self[word] = places
        return places


_PLACES = _Places()


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the features that occur."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    places = set(itertools.chain.from_iterable(map(_PLACES.__getitem__, set(words))))
    return len(words), np.fromiter(places, np.int32, len(places))


@dataclass
class Classifier:
    """Multinomial logistic regression over which features occur: one weight row per feature."""

    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, places: np.ndarray) -> np.ndarray:
        z = self.bias + self.weights[places].sum(axis=0, dtype=np.float64)
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[np.ndarray], domains: np.ndarray) -> Classifier | None:
    """Full-batch gradient ascent with per-weight steps and an L2 penalty; None without rows."""
    if not len(rows):
        return None
    k = len(DOMAINS)
    common = np.bincount(np.concatenate(rows), minlength=FEATURES) >= min(MIN_DOCS, len(rows) // 10)
    rows = [r[common[r]] for r in rows]
    lengths = np.array([len(r) for r in rows])
    place = np.concatenate(rows)
    order = np.argsort(place, kind="stable").astype(np.int32)
    used, heads = np.unique(place[order], return_index=True)
    rank = np.searchsorted(used, place).astype(np.int32)
    by_place = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)[order]
    w, bias = np.zeros((len(used), k), np.float32), np.zeros(k)
    # First and second moments of the gradients, of weights and of the bias (Adam).
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    gold = np.eye(k)[domains]
    for t in range(1, STEPS + 1):
        z = np.zeros((len(rows), k))
        if len(place):
            z[lengths > 0] = np.add.reduceat(w[rank], starts, axis=0)
        z += bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        error = ((gold - e / e.sum(axis=1, keepdims=True)) / len(rows)).astype(np.float32)
        size = RATE * (1 - t / (STEPS + 1)) / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
        for x, grad, at in ((bias, error.sum(axis=0), 2), (w, np.add.reduceat(error[by_place], heads, axis=0) - REGULARISATION / len(rows) * w if len(place) else w, 0)):
            first, second = moments[at], moments[at + 1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            x += size * first / (np.sqrt(second) + 1e-9)
    weights = np.zeros((FEATURES, k), np.float32)
    weights[used] = w
    return Classifier(weights, bias)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py())[1].tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["domain", "places"])


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """Fitted on at most ``SAMPLE_ROWS`` labelled documents; None without any.

    The sample is the labelled ids with the smallest hashes, so it does not depend on the data's layout.
    It is broadcast, and its features reach the driver: the parameter bounds both. Of several rows with
    one id, one counts.
    """
    chosen = domain_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("domain").alias("domain"), F.max("text").alias("text"))
    rows = map_arrow(sample.select("domain", "text"), _feature_batches, "domain int, places binary").collect()
    return train([np.frombuffer(bytes(r.places), np.int32) for r in rows], np.array([r.domain for r in rows], np.int64))


def _posteriors(model: Classifier | None):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(DOMAINS)
        for batch in batches:
            counts, p = [], []
            for text in batch.column(2):
                n, places = features(text.as_py())
                counts.append(float(n))
                p.append(model.posterior(places).tolist() if model else [1 / k] * k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.float64()), pa.array(p, pa.list_(pa.float64()))], ["doc_id", "rk", "n", "p"])

    return find


def posteriors(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """``doc_id, rk, n, p``: row key, words and one probability per domain for every row."""
    rows = docs.select("doc_id", row_key().alias("rk"), "text")
    return map_arrow(rows, _posteriors(model), "doc_id long, rk long, n double, p array<double>")


Step = tuple[list[float], float]
# Sums of a candidate: totals, distance, integral, curvature.
WIDTH = len(DOMAINS) + 2 + len(DOMAINS) ** 2


def rate(p: np.ndarray, steps: list[Step]) -> np.ndarray:
    """The rates of documents with posteriors ``p`` after the given ``(step, pull)``, from rate 1."""
    r = np.ones(len(p))
    for step, pull in steps:
        r = np.clip(r - p @ np.asarray(step) - pull * (r - 1), 0.0, MOST_USES)
    return r


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words and posteriors of a batch of ``posteriors``."""
    n = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
    return n, batch.column(batch.schema.get_field_index("p")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))


def summed(n: np.ndarray, p: np.ndarray, steps: list[Step], candidates: list[Step]) -> np.ndarray:
    """Per candidate: domain totals, squared distance of the rates from 1, the integral of the projection, and
    the curvature over rates inside the bounds."""
    before, found = rate(p, steps), []
    for step, pull in candidates:
        x = before - p @ np.asarray(step) - pull * (before - 1)
        r = np.clip(x, 0.0, MOST_USES)
        inside = (x > 0) & (x < MOST_USES)
        q = p[inside]
        found.append(np.concatenate([(r * n) @ p, [n @ (r - 1) ** 2, n @ (r * x - r * r / 2)], (q.T @ (q * n[inside][:, None])).ravel()]))
    return np.array(found)


def _sum_batches(steps: list[Step], candidates: list[Step]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sum((summed(*_columns(batch), steps, candidates) for batch in batches), np.zeros((len(candidates), WIDTH)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(candidates)), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["candidate", "sums"])

    return run


@dataclass
class Fit:
    """Steps of the fit, wanted and reachable totals of the domains, and the totals that the rates give."""

    steps: list[Step]
    wanted: np.ndarray
    reachable: np.ndarray
    totals: np.ndarray

    def error(self) -> float:
        """Largest error of a total, relative to its wanted total."""
        there = self.wanted > 0
        return float(np.abs(self.totals - self.wanted)[there].max(initial=0.0) if not there.any() else (np.abs(self.totals - self.wanted)[there] / self.wanted[there]).max())


def fit_rates(table: DataFrame, weights: dict[str, float] = WEIGHTS) -> Fit:
    """Projected gradient descent on ``table(n, p)``, to a standstill or to ``TOLERANCE``."""
    k = len(DOMAINS)

    def measure(steps: list[Step], candidates: list[Step]) -> np.ndarray:
        parts = map_arrow(table.select("n", "p"), _sum_batches(steps, candidates), "candidate int, sums array<double>")
        rows = parts.groupBy("candidate").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(WIDTH)]).collect()
        found = np.zeros((len(candidates), WIDTH))
        for row in rows:
            found[row[0]] = [float(x or 0.0) for x in row[1:]]
        return found

    own = [F.coalesce(F.sum(F.col("n") * F.get("p", F.lit(d)) * F.get("p", F.lit(d))), F.lit(0.0)) for d in range(k)]
    return descend(measure, np.array([float(x) for x in table.agg(*own).first()]), np.array([weights[d] for d in DOMAINS]))


def descend(measure: Callable[[list[Step], list[Step]], np.ndarray], sure: np.ndarray, weights: np.ndarray) -> Fit:
    """The fit over what ``measure(steps, candidates)`` sums up; ``sure`` are a domain's tokens weighted by its posterior."""
    k = len(DOMAINS)
    nothing: Step = ([0.0] * k, 0.0)
    at = measure([], [nothing])[0]
    now, words = at[:k].copy(), at[:k].sum()
    wanted = now[0] * weights / weights[0]
    reachable = np.minimum(wanted, now + (MOST_USES - 1) * sure)
    has_say = (now > 1e-9) & (wanted > 1e-9)
    scale = np.where(has_say, np.maximum(wanted, 1e-9), np.inf)

    def objective(x: np.ndarray) -> float:
        value = float((((x[:k] - reachable) / scale) ** 2).sum() + PULL * x[k] / words) / 2
        return value if np.isfinite(value) else np.inf

    def curvature(x: np.ndarray) -> np.ndarray:
        return x[k + 2 :].reshape(k, k) / np.outer(scale, scale)

    def dual(x: np.ndarray, m: np.ndarray) -> float:
        """What the best ``m`` maximises, in coordinates of ``m * scale``."""
        held = np.where(has_say, scale, 0.0)
        value = float(-x[k + 1] - (reachable * m).sum() - PULL / words / 2 * ((held * m) ** 2).sum())
        return value if np.isfinite(value) else -np.inf

    steps: list[Step] = []
    if not has_say.any():
        return Fit(steps, wanted, reachable, now)
    largest = float(np.linalg.eigvalsh(curvature(at)).max()) + PULL / words
    m, at_m, idle = np.zeros(k), at, 0
    while True:
        error = np.where(has_say, (at[:k] - reachable) / scale, 0.0)
        if np.abs(error).max() <= TOLERANCE or idle == IDLE:
            return Fit(steps, wanted, reachable, at[:k])
        candidates: list[Step] = [((error / scale * size / largest).tolist(), size * PULL / words / largest) for size in (1.0, 10.0)]
        slope = np.where(has_say, (at_m[:k] - reachable) / scale - PULL / words * scale * m, 0.0)
        c = curvature(at_m) + PULL / words * np.eye(k)
        moved = [m + size * np.linalg.solve(c + ridge * largest * np.eye(k), slope) / scale for ridge in RIDGES for size in (1.0, 0.3)]
        candidates += [(x.tolist(), 1.0) for x in moved]
        found = measure(steps, candidates)
        best = min(range(len(candidates)), key=lambda i: objective(found[i]))
        idle = 0 if objective(found[best]) < (1 - STANDSTILL) * objective(at) else idle + 1
        values = [dual(x, y) for x, y in zip(found[2:], moved, strict=True)]
        if max(values) > dual(at_m, m):
            i = int(np.argmax(values))
            m, at_m = moved[i], found[2 + i]
        if objective(found[best]) < objective(at):
            steps = [*([] if candidates[best][1] == 1.0 else steps), candidates[best]]
            at = found[best]


def _rated(steps: list[Step]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate(_columns(batch)[1], steps), pa.float64())], [*batch.schema.names, "rate"])

    return run


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``doc_id, rk, n, p, rate``: every row of ``docs`` with its words, domain posterior and rate.

    NULL and empty texts have no words and do not move the totals; they get the rate their posterior
    implies. Repeated rows get equal rates. Without labels the posterior is uniform. A domain without
    tokens has no say. Labels of unknown documents are ignored. An empty table gives no rows. Posteriors are
    written as a table once; every round of the fit reads that. Targets that can not be met within
    ``MOST_USES`` are met as far as possible, with a warning that says by how much they are missed.
    """
    table = materialised(posteriors(docs, fit_classifier(docs, labels)), "posteriors")
    fit = fit_rates(table, weights)
    if fit.error() > 0.02:
        share = lambda x: ", ".join(f"{d} {v:.3f}" for d, v in zip(DOMAINS, x / max(x.sum(), 1e-300), strict=True))
        warnings.warn(f"mixing: wanted shares {share(fit.wanted)}; the documents give {share(fit.totals)} with at most {MOST_USES} uses each", stacklevel=2)
    return map_arrow(table, _rated(fit.steps), "doc_id long, rk long, n double, p array<double>, rate double")


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate``: one row per document."""
    p = [F.get("p", F.lit(d)).alias(f"p_{name}") for d, name in enumerate(DOMAINS)]
    return mixed(docs, labels).select("doc_id", F.col("n").cast("long").alias("n_tokens"), *p, "rate")


def uses(rate: Column, key: Column) -> Column:
    """A whole number of uses whose mean is the rate: its floor, and one more for a seeded share of the keys."""
    draw = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def selected(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says, and at most ``MOST_USES`` times.

    A rate between whole numbers is rounded up or down by the row's key, so that token totals are the
    targets on average over documents. A row with two uses is there twice; equal rows have equal uses.
    """
    counted = mixed(docs, labels, weights).select("rk", uses(F.col("rate"), F.col("rk")).alias("uses"))
    others = materialised(counted.where("uses != 1").distinct(), "uses")
    placed = docs.select(F.struct("*").alias("row"), row_key().alias("rk")).join(others, "rk", "left")
    n = F.coalesce("uses", F.lit(1).cast("long"))
    return placed.where(n > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), n))).select("row.*")
