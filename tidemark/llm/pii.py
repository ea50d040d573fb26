"""Personal data by fixed patterns and a skip-chain conditional random field.

The base matcher finds emails, addresses, card and phone numbers by pattern and check. A skip-chain CRF
adds what it misses. Its nodes are the tokens (runs without white space) that have a digit or an ``@``;
any other token is no entity by definition, so it needs no node. Edges join neighbouring tokens and, far
apart in the document, tokens that are equal or end in the same seven digits: all of them meet in one node
of their own, so a token that occurs a thousand times costs a thousand edges and each is two edges from
any other. Short tokens (under seven characters) that belong to a base span do not meet their equals: a 12
in a phone number says nothing about other twelves. Repeats share what their shape says: each has its part of it.
Tokens that a base span touches have its label for certain. All edges of a kind have the same
potentials; loopy belief propagation passes messages until a document's have settled. Tokens whose
entity probability is high enough and that no base span touches become spans.

The field is trained here, by pseudo-likelihood, on a bounded sample of documents. Labels are those of the
base spans, and of tokens that repeat one of theirs. Inference covers every document and whole texts.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, row_key

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# Bounds of the training sample: documents, and their length. Nothing else is bounded.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
# Messages that change by no more have settled.
SETTLED = 1e-6
CONFIDENCE = 0.9
STEPS = 300
L2 = 1e-4
# Repeats agree unless the sample says otherwise: where the penalty pulls the weights of repeats to while the
# others are trained, and how many edges between equal labels are assumed besides those of the sample.
REPEATS_AGREE = 1.5
AGREED = 50_000

# --- base spans ------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits either starts a match at its first digit or not at all, so inner digits need no try.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each ``@``: the pattern's local part ends there, so it starts where such characters begin."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the base matches, in order; offsets in code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        # Parts as numbers: leading zeros do not count, and long runs are not converted.
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


# --- tokens and graph ------------------------------------------------------------------------------------

_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = ".,;:!?\"'"
SIMILAR = 7  # characters, or last digits
_FEATURES = 24


def tokens(text: str) -> list[tuple[int, int, int, str]]:
    """Position among all tokens, start, end and text of the tokens that can be part of an entity."""
    if not _MARK.search(text):
        return []
    return [(i, m.start(), m.end(), m[0]) for i, m in enumerate(_TOKEN.finditer(text)) if _MARK.search(m[0])]


def features(token: str) -> list[int]:
    """Which of the binary features a token has: its shape, never its identity."""
    core = token.strip(_EDGE)
    digits = len(_NOT_DIGIT.sub("", core))
    out = [0, 1 + min(digits, 20) // 3]  # 1..7
    tests = (
        "@" in core, "@" in core and "." in core.rpartition("@")[2], core.startswith("@"), core.count(".") == 3,
        "." in core, core.startswith("+"), "(" in core, ")" in core, "-" in core, digits == len(core), any(c.isalpha() for c in core),
        "=" in core, ":" in core or "/" in core, len(core) > 19, bool(core) and core[0] in "0123456789", digits == 4,
    )
    return out + [8 + k for k, t in enumerate(tests) if t]


@dataclass
class Graph:
    """Tokens of many documents with their edges; documents are separate parts of one graph.

    After the tokens come the nodes in which repeats meet; they have no place and no shape.
    """

    doc: np.ndarray  # of tokens and meeting nodes
    start: np.ndarray  # of tokens
    end: np.ndarray
    shape: np.ndarray  # tokens x features
    near: np.ndarray  # m x 2: neighbours in the text, left then right
    skip: np.ndarray  # m x 2: token, node in which it meets its repeats
    short: np.ndarray | None = None  # of these, those of short tokens


def without_chance(g: Graph, labels: np.ndarray) -> Graph:
    """The graph in which short tokens that have an entity label do not meet their equals."""
    if g.short is None or not len(g.skip):
        return g
    keep = ~(g.short & (labels[g.skip[:, 0]] > 0))
    return replace(g, skip=g.skip[keep], short=g.short[keep])


def mark(token: str) -> str:
    """What a token has in common with its repeats. One mark a token, so that repeats alone make no loops."""
    core = token.strip(_EDGE).lower()
    digits = _NOT_DIGIT.sub("", core)
    return digits[-SIMILAR:] if len(digits) >= SIMILAR and "@" not in core else core


def graph(texts: list[str]) -> Graph:
    doc, start, end, near = [], [], [], []
    rows: list[list[int]] = []
    meet: list[tuple[str, list[int]]] = []  # mark and tokens of each meeting node
    where: list[int] = []  # and its document
    for d, text in enumerate(texts):
        last_place, members = -2, {}
        for place, a, b, token in tokens(text):
            k = len(doc)
            doc.append(d)
            start.append(a)
            end.append(b)
            rows.append(features(token))
            if place == last_place + 1:
                near.append((k - 1, k))
            last_place = place
            members.setdefault(mark(token), []).append(k)
        groups = [(m, group) for m, group in members.items() if len(group) > 1]
        meet += groups
        where += [d] * len(groups)
    n = len(doc)
    shape = np.zeros((n, _FEATURES))
    for k, on in enumerate(rows):
        shape[k, on] = 1.0
    skip = [(k, n + g) for g, (_, group) in enumerate(meet) for k in group]
    short = np.array([len(m) < SIMILAR for m, group in meet for _ in group], bool)
    pairs = [np.array(e, np.int64).reshape(-1, 2) for e in (near, skip)]
    return Graph(np.array(doc + where, np.int64), np.array(start, np.int64), np.array(end, np.int64), shape, *pairs, short)


# --- the field -------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Log potentials: of a token's shape, of neighbours (left, right), of skip edges (a multiple of one)."""

    node: np.ndarray
    near: np.ndarray
    skip: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


# Log potential of what can not be.
_IMPOSSIBLE = -100.0


def _normal(x: np.ndarray) -> np.ndarray:
    return x - x.max(axis=-1, keepdims=True)


def _parts(g: Graph) -> np.ndarray:
    """The part of its shape's evidence that each token has: one over its repeats, itself included.

    Only where a base span can be evidence too: many repeats of what a pattern missed must not outvote
    the one that it found. Short tokens keep the whole of theirs.
    """
    on = g.skip if g.short is None else g.skip[~g.short]
    size = np.bincount(on[:, 1], minlength=len(g.doc)) if len(on) else np.zeros(len(g.doc), np.int64)
    most = np.ones(len(g.shape))
    np.maximum.at(most, on[:, 0], size[on[:, 1]])
    return 1 / most


def repeated_labels(g: Graph, labels: np.ndarray) -> np.ndarray:
    """Labels of tokens and meeting nodes: a node has the most frequent entity label of its tokens (ties:
    the first kind), and a token without a label takes that of a node it is in."""
    votes = np.zeros((len(g.doc), len(LABELS)), np.int64)
    np.add.at(votes, (g.skip[:, 1], labels[g.skip[:, 0]]), 1)
    votes[:, 0] = 0
    nodes = np.where(votes.any(axis=1), votes.argmax(axis=1), 0)
    nodes[: len(labels)] = 0
    found = np.zeros((len(labels), len(LABELS)), bool)
    found[g.skip[:, 0], nodes[g.skip[:, 1]]] = True
    found[:, 0] = False
    nodes[: len(labels)] = np.where(labels > 0, labels, np.where(found.any(axis=1), found.argmax(axis=1), 0))
    return nodes


def train(g: Graph, labels: np.ndarray) -> Field:
    """Weights of shapes and neighbours that maximise the pseudo-likelihood with an L2 penalty, by gradient
    ascent (Adam), and the weight of agreement from how often repeats agree.

    ``labels`` are those of base spans; ``repeated_labels`` completes them. In the pseudo-likelihood a repeat
    sees the one before and the one after it, with weights that are not used later. Agreement has one
    weight, whatever the label: else a thousand edges would add up what one label has more than another.
    Without tokens the weights are the prior.
    """
    k = len(LABELS)
    shapes = ((_FEATURES, k), (k, k), (k, k))
    prior = [np.zeros(shapes[0]), np.zeros(shapes[1]), REPEATS_AGREE * np.eye(k)]
    w = [x.copy() for x in prior]
    if not len(labels):
        return Field(w[0], w[1], np.log((k - 1) * AGREED) * np.eye(k))
    g = without_chance(g, labels)
    full = repeated_labels(g, labels)
    differ = int((full[g.skip[:, 0]] != full[g.skip[:, 1]]).sum())
    agreement = np.log((k - 1) * (AGREED + len(g.skip) - differ) / (1 + differ))
    n = len(labels)
    full = full[:n]
    gold = np.eye(k)[full]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    a, b = g.near[:, 0], g.near[:, 1]
    c, d = g.skip[:-1, 0], g.skip[1:, 0]  # edges are in order of their meeting node
    same = g.skip[:-1, 1] == g.skip[1:, 1]
    c, d = c[same], d[same]
    for t in range(1, STEPS + 1):
        score = g.shape @ w[0]
        np.add.at(score, b, w[1][full[a]])
        np.add.at(score, a, w[1].T[full[b]])
        np.add.at(score, d, w[2][full[c]])
        np.add.at(score, c, w[2][full[d]])
        error = gold - _softmax(score)
        grads = [g.shape.T @ error, gold[a].T @ error[b] + error[a].T @ gold[b], gold[c].T @ error[d] + gold[d].T @ error[c]]
        grads[2] = (grads[2] + grads[2].T) / 2
        for i in range(3):
            grad = grads[i] / n - L2 * (w[i] - prior[i])
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad**2
            w[i] = w[i] + 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Field(w[0], w[1], agreement * np.eye(k))


def marginals(g: Graph, field: Field, known: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of all tokens by loopy belief propagation (sum-product, in logarithms).

    Tokens with a label in ``known`` have it for certain. Messages pass until those of a document have
    settled, whatever other documents do; from the 64th round on, a smaller and smaller part of each
    change is made, so that messages that would go round in circles come to rest.
    """
    if known is not None:
        g = without_chance(g, known)
    n = len(g.shape)
    local = np.zeros((len(g.doc), len(LABELS)))
    local[:n] = (g.shape @ field.node) * _parts(g)[:, None]
    if known is not None:
        sure = np.flatnonzero(known)
        local[sure] = _IMPOSSIBLE
        local[sure, known[sure]] = 0.0
    edges = np.concatenate([g.near, g.skip])
    if not len(edges):
        return _softmax(local[:n])
    m, near = len(edges), len(g.near)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    # potential[e][from label, to label] of each directed edge
    forms = np.exp(np.stack([field.near, field.skip, field.near.T, field.skip.T]))
    which = np.concatenate([np.repeat([0, 1], [near, m - near]), np.repeat([2, 3], [near, m - near])])
    sent = np.zeros((2 * m, len(LABELS)))
    belief = local.copy()
    live = np.arange(2 * m)  # edges of documents that have not settled
    rounds = 0
    while len(live):
        rounds += 1
        given = _normal(belief[source[live]] - sent[back[live]])
        new = np.empty((len(live), len(LABELS)))
        for f in range(4):
            on = which[live] == f
            new[on] = _normal(np.log(np.exp(given[on]) @ forms[f] + 1e-300))
        change = (new - sent[live]) * min(1.0, 64 / rounds)
        sent[live] += change
        np.add.at(belief, target[live], change)
        moved = np.zeros(int(g.doc.max()) + 1, bool)
        moved[g.doc[source[live[np.abs(change).max(axis=1) > SETTLED]]]] = True
        live = live[moved[g.doc[source[live]]]]
    return _softmax(belief[:n])


def token_labels(g: Graph, base: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each token: the kind of the base span that touches it, the first of several."""
    out = np.zeros(len(g.start), np.int64)
    last, at = -1, 0
    for k, (d, a, b) in enumerate(zip(g.doc.tolist(), g.start.tolist(), g.end.tolist(), strict=False)):
        spans = base[d]
        if d != last:
            last, at, reach = d, 0, list(itertools.accumulate((e for _, _, e in spans), max))
        at = max(at, bisect.bisect_right(reach, a))  # spans before end at or before the token's start
        for start, kind, end in spans[at:]:
            if start >= b:
                break
            if a < end:
                out[k] = kind + 1
                break
    return out


class Taken:
    """Which places of a text base spans cover; answers in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [a for a, _, _ in spans]
        self.reach = list(itertools.accumulate((b for _, _, b in spans), max))

    def touches(self, a: int, b: int) -> bool:
        before = bisect.bisect_left(self.starts, b)
        return before > 0 and self.reach[before - 1] > a


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text: runs of neighbouring tokens of one confident label."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = graph(texts)
    if not len(g.doc):
        return out
    known = token_labels(g, base)
    p = marginals(g, field, known)
    label = np.where((p.max(axis=1) >= CONFIDENCE) & (known == 0), p.argmax(axis=1), 0)
    joined = {int(b): int(a) for a, b in g.near}
    taken = [Taken(spans) for spans in base]
    open_run: tuple[int, int, int] | None = None
    for k in np.flatnonzero(label).tolist():
        d, kind = int(g.doc[k]), int(label[k]) - 1
        if open_run and joined.get(k) == open_run[1] and label[open_run[1]] == label[k]:
            open_run = (open_run[0], k, kind)
        else:
            _close(open_run, g, texts, taken, out)
            open_run = (k, k, kind)
    _close(open_run, g, texts, taken, out)
    return out


def _close(run: tuple[int, int, int] | None, g: Graph, texts: list[str], taken: list[Taken], out: list[list[tuple[int, int, int]]]) -> None:
    """Turn a run of tokens into a span without outer punctuation, unless a base span touches it."""
    if run is None:
        return
    first, last, kind = run
    d = int(g.doc[first])
    a, b = int(g.start[first]), int(g.end[last])
    text = texts[d]
    while a < b and text[a] in _EDGE:
        a += 1
    while b > a and text[b - 1] in _EDGE:
        b -= 1
    if a < b and not taken[d].touches(a, b):
        out[d].append((a, kind, b))


# --- on Spark --------------------------------------------------------------------------------------------


def fit(docs: DataFrame) -> Field:
    """Train on the sampled documents: those with digits or ``@`` that have the smallest row keys.

    The keys are chosen first, so only the texts of the sample reach the driver (and their number and
    length are bounded).
    """
    some = docs.select(row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text")).where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    chosen = some.select("rk").distinct().orderBy("rk").limit(SAMPLE_DOCS)
    texts = [r.text for r in some.join(F.broadcast(chosen), "rk").dropDuplicates(["rk"]).orderBy("rk").select("text").collect()]
    g = graph(texts)
    return train(g, token_labels(g, [base_spans(t) for t in texts]))


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"
_NAMES = [f.split()[0] for f in SPANS.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in SPANS.split(", ")]


def _finder(field: Field):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) if _MARK.search(t) else [] for t in texts]
            added = added_spans(texts, base, field)
            rows = [
                (doc_id, *(sum(k == kind for _, k, _ in b) for kind in range(len(KINDS))), _shown(b), _shown(sorted(b + more)), len(more))
                for doc_id, b, more in zip(ids, base, added, strict=True)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    return find


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added``: one row per document.

    Counts and ``base`` are those of the base matcher; ``spans`` adds those of the field. Spans are
    ``kind:start:end`` in code points, end exclusive, by start and kind, joined by commas. NULL and empty
    texts have none. Repeated rows are alike; rows without an id are kept. Other columns are not read.
    """
    return map_arrow(docs.select("doc_id", "text"), _finder(fit(docs)), SPANS)


def digest(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
