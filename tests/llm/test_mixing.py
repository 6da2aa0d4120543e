"""Weights, budgets and block permutations against plain code."""

import math
from collections import Counter, defaultdict

import pytest

from measureloom.llm import mixing as mx


def test_exponent_meets_the_entropy_target():
    tokens = {"a": 10_000, "b": 500, "c": 100, "d": 0}
    for goal in (0.5, 0.8, 0.95):
        w = mx.weights(tokens, mx.bisect_exponent(tokens, target_entropy=goal))
        assert math.isclose(mx.entropy(w), goal * math.log(3), rel_tol=1e-9) and w["d"] == 0
    assert mx.bisect_exponent(tokens, target_entropy=0.01) == pytest.approx(1)


def test_exponent_meets_the_repetition_limit():
    tokens = {"a": 10_000, "b": 500, "c": 100}
    for most in (1.5, 3, 10):
        w = mx.weights(tokens, mx.bisect_exponent(tokens, max_repeats=most, budget=10_600))
        assert max(10_600 * w[s] / t for s, t in tokens.items()) == pytest.approx(most, rel=1e-6)
    assert mx.bisect_exponent({"a": 5}, target_entropy=0.5) == 1.0


def test_budgets_add_up():
    tokens = {"a": 7, "b": 3, "c": 0, None: 2}
    parts = mx.budgets(tokens, mx.weights(tokens, 0.4), 101)
    assert sum(parts.values()) == 101 and parts["c"] == 0


def texts(n=90):
    return [None if k % 17 == 0 else "" if k % 19 == 0 else " ".join(["w"] * (1 + k * 7 % 40) + [str(k)]) for k in range(n)]


def test_drawn_documents_fill_the_budgets(docs):
    bodies = texts()
    source = lambda k: "big" if k < 60 else "mid" if k < 82 else None
    df = docs(bodies, source=source)
    size = {k: len((t or "").split()) for k, t in enumerate(bodies)}
    tokens = defaultdict(int)
    for k, n in size.items():
        tokens[source(k)] += n
    goal = sum(tokens.values())
    parts = mx.budgets(dict(tokens), mx.weights(tokens, mx.bisect_exponent(dict(tokens), 0.97, 4.0, goal)), goal)
    rows = mx.mix(df, target_entropy=0.97, block_tokens=100).collect()
    by = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == size[r["doc_id"]] and r["text"] == bodies[r["doc_id"]]
        by[r["source"]].append(r)
    for s, drawn in by.items():
        members = [k for k in size if source(k) == s]
        epochs = Counter(r["epoch"] for r in drawn)
        whole = parts[s] // tokens[s]
        for e in range(whole):
            assert sorted(r["doc_id"] for r in drawn if r["epoch"] == e) == members  # a permutation of the source
        assert max(epochs) <= whole
        last = sum(r["n_tokens"] for r in drawn if r["epoch"] == whole)
        left = parts[s] - whole * tokens[s]
        assert left <= last <= left + max(size[k] for k in members) if left else last == 0
        # Blocks are read one after the other: the same documents share a block in every pass.
        assert all(len({r["block"] for r in drawn if r["epoch"] == e}) == 1 + max(r["block"] for r in drawn if r["epoch"] == e)
                   for e in epochs)
        together = defaultdict(set)
        for r in drawn:
            together[(r["epoch"], r["block"])].add(r["doc_id"])
        full = {frozenset(v) for (e, _), v in together.items() if e < whole}
        assert len(full) <= max(1, round(tokens[s] / 100))


def test_repeated_rows_clashing_columns_and_empty_tables(docs):
    df = docs(["a b", "a b", None], ids=[1, 1, 2]).selectExpr("*", "1 as _s", "2 as epoch", "'x' as place")
    out = mx.mix(df)
    assert set(out.columns) == set(df.columns) | {"n_tokens", "block"}
    assert sorted(r["doc_id"] for r in out.collect() if r["n_tokens"]) == [1, 1]
    assert mx.mix(docs([])).count() == 0
    assert mx.mix(docs([None, ""])).count() == 0


def test_the_same_without_broadcast(docs, monkeypatch):
    df = docs(texts(60))
    rows = sorted(map(str, mx.mix(df, block_tokens=60).select("doc_id", "epoch", "block").collect()))
    monkeypatch.setattr(mx, "small_enough", lambda keys, bound=0: keys)
    assert sorted(map(str, mx.mix(df, block_tokens=60).select("doc_id", "epoch", "block").collect())) == rows


def test_the_plan_needs_no_python_workers(make, monkeypatch):
    from pyspark import SparkContext

    docs = make("doc_id int, text string, source string", [(i, "a b c " * (i + 1), None if i % 3 else "s") for i in range(9)])

    def refused(*args, **kwargs):
        raise AssertionError("rows unpacked by Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert {r["source"] for r in mx.mix(docs).collect()} == {None, "s"}
