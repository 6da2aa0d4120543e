"""Projection passes against all pairs."""

import math
import random

import numpy as np

from measureloom.llm import embedding_dedup as ed


def clusters(seed=1, groups=12, size=12, dims=24):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(dims)]
        for k in range(size if g else 60):
            noise = rng.choice([0.0, 0.03, 0.1, 0.2])
            rows.append(([x + rng.gauss(0, noise) if noise else x for x in centre], rng.randrange(2)))
    rng.shuffle(rows)
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def expected(rows, threshold=0.98):
    def fine(v, label):
        return label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)

    near = {i: [] for i, _, _ in rows}
    for a, v, x in rows:
        for b, w, y in rows:
            if a < b and x == y and fine(v, x) and fine(w, y) and len(v) == len(w):
                if sum(p * q for p, q in zip(v, w, strict=True)) / math.hypot(*v) / math.hypot(*w) >= threshold:
                    near[a].append(b)
                    near[b].append(a)
    low = {}
    for i in sorted(near):
        todo = [] if i in low else [i]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = i
                todo += near[x]
    return sorted((i, len(near[i]), low[i], low[i] == i) for i in near)


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    return sorted(tuple(r) for r in ed.near_duplicates(df, **settings).collect())


def test_against_all_pairs(spark, monkeypatch):
    rows = clusters()
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] * 24, 1), (1004, [None] * 24, 1),
             (1005, rows[0][1], None), (1006, rows[0][1], rows[0][2]), (1007, [2 * x for x in rows[0][1]], rows[0][2]),
             (1008, [float("inf")] + [1.0] * 23, 0), (1009, rows[0][1][:5], rows[0][2])]
    monkeypatch.setattr(ed, "BLOCK", 16)
    monkeypatch.setattr(ed, "ROWS", 300)
    assert run(spark, rows) == expected(rows)


def test_a_narrow_window_reaches_through_passes(spark):
    rows = clusters(seed=2, groups=3, size=30)
    assert run(spark, rows, window=4) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_clashing_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1, 7), (None, [1.0, 2.0], 1, 8)],
                               "vec_id bigint, embedding array<float>, label int, vid int")
    assert [tuple(r) for r in ed.near_duplicates(df).collect()] == [(None, 1, None, True)] * 2


def cloud(n, seed=4, dims=64):
    """Vectors at mutual cosines of 0.95, and a partner at 0.982 for every tenth."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    x = unit(unit(rng.standard_normal(dims)) + math.sqrt(1 / 0.95 - 1) * unit(rng.standard_normal((n, dims))))
    some = x[::10]
    side = rng.standard_normal(some.shape)
    side = unit(side - (side * some).sum(1, keepdims=True) * some)
    return np.concatenate([x, 0.982 * some + math.sqrt(1 - 0.982**2) * side])


def test_links_within_a_crowd_below_the_threshold(spark, monkeypatch):
    x = cloud(2000)
    near = (x @ x.T >= 0.98).sum(1) - 1
    assert (near > 0).sum() >= 400
    monkeypatch.setattr(ed, "CROWD", 512, raising=False)
    got = run(spark, [(i, v, 1) for i, v in enumerate(x.tolist())])
    assert [r[1] for r in got] == near.tolist()
