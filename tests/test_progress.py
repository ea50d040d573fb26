"""Formulas letter by letter, against the recursive definition and the values of the whole word."""

from __future__ import annotations

import json
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from test_streaming import events, file_stream
from test_temporal import FORMULAS, TREES, build, meaning

from pyspark.sql import functions as F

from tidemark.operators import temporal as T
from tidemark.operators.atoms import exists_element, foreach_element
from tidemark.operators.letters import letters
from tidemark.operators.progress import Progress, plan_of
from tidemark.operators.windows import Windows
from tidemark.streaming.monitor import monitor_formula
from tidemark.streaming.recorder import record_stream


def leaves_of(f):
    """The letter values a formula's leaves read, in the order of the plan's leaves."""
    if f[0] in ("a", "b", "c"):
        return [f[0]]
    return [x for part in f[1:] if isinstance(part, tuple) for x in leaves_of(part)]


def plain(f):
    kind = f[0]
    if kind in "abc":
        return T.coded(kind)
    if kind == "next":
        return T.next_(plain(f[1]))
    if kind == "always":
        return T.always(plain(f[1]), f[2])
    if kind == "eventually":
        return T.eventually(plain(f[1]), f[2])
    if kind == "until":
        return T.until(plain(f[1]), plain(f[2]), f[3])
    left, right = plain(f[1]), plain(f[2])
    return {"and": left & right, "or": left | right, "implies": left >> right}[kind]


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    """Columns need a running session."""


def told(f, word, cuts):
    """Values told along a word fed in runs of equal letters, with the state written and read at each cut."""
    plan, _ = plan_of(plain(f))
    machine, out = Progress(plan), []
    names = leaves_of(f)
    at = {"a": lambda w: 1 if w[0] else -1, "b": lambda w: 1 if w[1] else -1, "c": lambda w: w[2]}
    i = 0
    while i < len(word):
        n = 1
        while i + n < len(word) and word[i + n] == word[i] and i + n not in cuts:
            n += 1
        for value, count in machine.feed(tuple(at[x](word[i]) for x in names), n):
            out += [value] * count
        i += n
        assert len(out) <= i
        if i in cuts:
            machine = Progress(plan).load(json.loads(json.dumps(machine.dump())))
    for value, count in machine.finish():
        out += [value] * count
    return out


def random_word(rng, longest):
    word = []
    while len(word) < longest:
        letter = (rng.random() < 0.7, rng.random() < 0.3, rng.choice([-1, 0, 1]))
        word += [letter] * rng.choice([1, 1, 2, 5])
    return word[: rng.randint(0, longest)]


@pytest.mark.parametrize("i", range(len(FORMULAS)))
def test_against_definition(i):
    rng = random.Random(i)
    for _ in range(60):
        word = random_word(rng, 16)
        cuts = {rng.randrange(1, 17) for _ in range(3)}
        assert told(FORMULAS[i], word, cuts) == [meaning(FORMULAS[i], word, k) for k in range(len(word))]


@settings(max_examples=300, deadline=None)
@given(f=TREES, seed=st.integers(0, 10**6))
def test_random_formulas(f, seed):
    rng = random.Random(seed)
    word = random_word(rng, 14)
    cuts = {rng.randrange(1, 15) for _ in range(3)}
    assert told(f, word, cuts) == [meaning(f, word, k) for k in range(len(word))]


def test_values_come_as_soon_as_they_are_decided():
    plan, _ = plan_of(T.until(T.coded("a"), T.coded("b"), 3))
    machine = Progress(plan)
    assert machine.feed((1, -1), 2) == [] and machine.feed((1, 1)) == [(1, 3)]
    assert machine.feed((-1, -1)) == [(-1, 1)] and machine.feed((1, -1), 1_000_000) == [(-1, 999_998)]
    assert machine.finish() == [(0, 2)]


def test_one_part_alone_decides():
    plan, _ = plan_of(T.coded("a") & T.always(T.coded("b"), 100))
    machine = Progress(plan)
    assert machine.feed((-1, 1), 5) == [(-1, 5)] and machine.feed((1, 1), 20) == []
    assert machine.feed((1, -1)) == [(-1, 21)]


def test_state_does_not_grow_with_the_horizon():
    rng = random.Random(1)
    sizes = {}
    for horizon in (10, 100_000):
        plan, _ = plan_of(T.always(T.eventually(T.until(T.coded("a"), T.coded("b"), horizon), horizon), horizon))
        machine, most = Progress(plan), 0
        for _ in range(3000):
            machine.feed((rng.choice([1, 1, 0]), rng.choice([-1, -1, -1, 0, 1])))
            most = max(most, len(str(machine.dump()).replace("-", "")))
        sizes[horizon] = most
    assert sizes[100_000] < sizes[10] + 60


def test_binding_is_refused():
    with pytest.raises(ValueError, match="BindNext"):
        plan_of(T.bind_next(lambda this, following: this("a") == following("a")))


@pytest.mark.parametrize("by", [["k"], []])
def test_stream_in_many_batches(spark, by):
    """Eight micro-batches, the machine stored in between, give what the whole word gives."""
    _, df = events(spark, seed=6, n=60)
    windows = Windows(100, start_ms=250, strict=True)
    atoms = [foreach_element("a", F.col("v") > 1), exists_element("b", F.col("v") > 7)]
    formula = T.until(T.now("a"), T.now("b"), 4) | T.next_(T.always(T.now(F.col("n_rows") > 0), 2))

    out = record_stream(
        file_stream(spark, df, 6), lambda s: monitor_formula(s, formula, windows, atoms, by), "formula"
    )
    expected = T.evaluate(letters(windows, by, rows=(df, atoms)), formula, by)
    assert rows(out, *by, "idx", "value") == rows(expected, *by, "idx", "value")
