import hashlib
import re

import numpy as np
from llm_data import documents, edge_texts

from tidemark.llm import pii

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
TEXTS = [
    "mail a.b+c@x-y.example.com, and x@y or @z.com a@b.c@d.e a@b.co_q@d.ef .@-.-",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.255 1.2.3 9999999999.1.1.1 1..2.3.4 é1.2.3.4é",
    "card 4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111 1111  1111 1111 12345678901234567890",
    "phone +1 (988) 555-2485 +1 2 +49.30.123456789 +12345678901234567 ++1 234 567 8901- +1 (5) ",
    "call +1 (578) 555-6437 4918187128635271 now", "1" * 5000, "1." * 3000, "a" * 20000 + "@", "+" * 3000 + "1", "@" * 2000, "1 " * 3000, "é@x.com 🙂 a@é.com a@x.é",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    out = []
    for k, (pattern, ok) in enumerate(PATTERNS.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return sorted(out)


def test_base_spans_against_the_patterns():
    for text in TEXTS:
        assert pii.base_spans(text) == base(text), text[:60]


def test_query_on_edge_rows(spark):
    rows = edge_texts() + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(100, TEXTS[0]), (None, TEXTS[1])]
    got = sorted(map(tuple, pii.digest(documents(spark, rows)).collect()), key=str)
    names = list(PATTERNS)
    want = []
    for i, t in rows:
        spans = base(t or "")
        shown = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(k == q for _, k, _ in spans) for q in range(4)), hashlib.sha256(shown.encode()).hexdigest()))
        mine = [g for g in got if g[0] == i and g[:6] == want[-1]]
        assert mine and set(filter(None, shown.split(","))) <= set(mine[0][6].split(","))
    assert sorted((g[:6] for g in got), key=str) == sorted(want, key=str)
    assert pii.digest(documents(spark, [])).count() == 0


def sample(n=400):
    rng = np.random.default_rng(7)
    out = []
    for i in range(n):
        w = ["the", "of", "version", "3.", "in", "1999", "item", "12"] * 3
        ip = ".".join(str(x) for x in rng.integers(1, 255, 4))
        phone = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        w.insert(1 + 8 * int(rng.integers(0, 3)), [ip, phone, f"u{i}.x@mail{i % 9}.example.com", ""][i % 4])
        out.append(" ".join(w))
    return out


def test_held_out_accuracy():
    texts = sample()
    train, held = texts[:200], texts[200:]
    g = pii.graph(train)
    field = pii.train(g, pii.token_labels(g, [pii.base_spans(t) for t in train]))
    g = pii.graph(held)
    truth = pii.token_labels(g, [pii.base_spans(t) for t in held])
    assert (pii.marginals(g, field).argmax(axis=1) == truth).mean() > 0.97
    # No span where the base matcher finds all there is.
    assert sum(map(len, pii.added_spans(held, [pii.base_spans(t) for t in held], field))) == 0


def test_distant_repeats_share_a_label():
    """A token of unclear shape takes the label of its equal far away; without the edge it does not."""
    field = pii.Field(np.zeros((24, 5)), np.zeros((5, 5)), 3 * np.eye(5))
    g = pii.graph(["id70707 " + "word " * 50 + "id70707 " + "word " * 50 + "id70707", "id80808"])
    assert len(g.skip) == 3 and len(g.near) == 0 and len(g.doc) == 5
    strong = np.zeros((4, 24))
    strong[0, 23] = 1.0
    field.node[23, 2] = 18.0  # a third of it is the first token's part
    g.shape = strong
    p = pii.marginals(g, field)
    assert p[1, 2] > 0.5 and p[2, 2] > 0.5 and abs(p[3, 2] - 0.2) < 1e-6


def trained(texts):
    g = pii.graph(texts)
    return pii.train(g, pii.token_labels(g, [pii.base_spans(t) for t in texts]))


def test_evidence_at_one_place_labels_every_repeat():
    """Fifty repeats without the plus sign that the pattern asks for, and one with it, at either end or amid."""
    texts = sample() + [f"call +4930{i:07d} or 4930{i:07d} now" for i in range(20)] + [f"order 4931{i:07d} came" for i in range(60)]
    field = trained(texts)
    plain, sure = "49308765432", "+49308765432"
    for at in (0, 25, 50):
        parts = [plain] * 50
        parts.insert(at, sure)
        text = (" word" * 30 + " ").join(parts)
        base_ = pii.base_spans(text)
        (added,) = pii.added_spans([text], [base_], field)
        assert len(base_) == 1 and len(added) == 50 and {text[a:b] for a, _, b in added} == {plain} and {k for _, k, _ in added} == {3}
    # A short token in a base span says nothing about its equals.
    apart = "555 " + "word " * 9 + "+1 (826) 555 4081 " + "word " * 9 + "555 word 4081"
    assert pii.base_spans(apart) == base(apart) != [] and pii.added_spans([apart], [base(apart)], field) == [[]]
    # No evidence anywhere, or of another number: nothing.
    alone = " word ".join([plain] * 50)
    other = alone + " +49301111222"
    assert pii.added_spans([alone, other], [pii.base_spans(t) for t in (alone, other)], field) == [[], []]


def test_results_do_not_depend_on_the_other_documents_of_a_batch():
    texts = [f"{'a ' * k}+4930{k:07d} b 4930{k:07d} {k}" for k in range(30)] + ["1 " * 500, ""]
    field = trained(sample() + texts)
    whole = pii.added_spans(texts, [pii.base_spans(t) for t in texts], field)
    assert whole == [pii.added_spans([t], [pii.base_spans(t)], field)[0] for t in texts] and any(whole)


def test_spans_against_exact_inference():
    """On documents without a loop, spans are those of the exact distribution, summed over all labellings."""
    field = trained(sample() + [f"call +4930{i:07d} or 4930{i:07d} now" for i in range(20)])
    texts = ["see +493012345678 x 493012345678 y 493012345678", "a 493012345678 b 493012345678", "in 1999 3. and u1.x@mail1.example.com", "4930123456 and +4930123456 12"]
    for text in texts:
        base_ = pii.base_spans(text)
        g = pii.graph([text])
        known = pii.token_labels(g, [base_])
        g = pii.without_chance(g, known)
        n, nodes = len(g.shape), len(g.doc)
        whose = [(k, h) for (k, h), short in zip(g.skip.tolist(), g.short.tolist()) if not short]
        part = [1 / max(1, sum(h == q for k, q in whose if k == i for _, h in whose)) for i in range(n)]
        joint = np.full((5,) * nodes, -np.inf)
        for y in np.ndindex(*joint.shape):
            if all(k == 0 or y[i] == k for i, k in enumerate(known)):
                joint[y] = sum(part[i] * (g.shape[i] @ field.node)[y[i]] for i in range(n) if not known[i])
                joint[y] += sum(field.near[y[a], y[b]] for a, b in g.near) + sum(field.skip[y[a], y[b]] for a, b in g.skip)
        joint = np.exp(joint - joint.max())
        joint /= joint.sum()
        want = []
        for i in range(n):
            p = joint.sum(axis=tuple(k for k in range(nodes) if k != i))
            assert np.allclose(pii.marginals(g, field, known)[i], p, atol=1e-6)
            if not known[i] and p.argmax() and p.max() >= pii.CONFIDENCE:
                want.append((int(g.start[i]), int(p.argmax()) - 1, int(g.end[i])))
        assert pii.added_spans([text], [base_], field)[0] == want


def test_marginals_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(24, 5)), rng.normal(size=(5, 5)), np.zeros((5, 5)))
    field.skip = (lambda a: a + a.T)(rng.normal(size=(5, 5)))
    shape = rng.integers(0, 2, (4, 24)).astype(float)
    z = np.zeros(4, np.int64)
    g = pii.Graph(z, z, z, shape, np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    local = shape @ field.node
    joint = np.zeros((5,) * 4)
    for y in np.ndindex(*joint.shape):
        joint[y] = sum(local[i, y[i]] for i in range(4)) + field.near[y[0], y[1]] + field.near[y[1], y[2]] + field.skip[y[1], y[3]]
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    for i in range(4):
        exact = joint.sum(axis=tuple(k for k in range(4) if k != i))
        assert np.allclose(pii.marginals(g, field)[i], exact, atol=1e-9)


def test_missed_neighbours_are_found():
    """A phone number that runs into a card number fails both patterns; the field has seen their shapes."""
    texts = sample() + [f"pay 4111111111111111 to number {i}" for i in range(60)] + [f"see +1 ({300 + i}) 555-2{i:03d} 4111111111111111 x" for i in range(3)]
    base_ = [pii.base_spans(t) for t in texts]
    g = pii.graph(texts)
    field = pii.train(g, pii.token_labels(g, base_))
    added = pii.added_spans(texts, base_, field)
    assert base_[-1] == [] and {k for _, k, _ in added[-1]} & {2, 3}
