"""Votes against plain code, and held-out accuracy on invented texts."""

import random
import zlib

import numpy as np

from measureloom.llm import quality_knn as qk


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 9)))
    texts, labels = [], []
    for _ in range(n):
        body = [word() for _ in range(rng.randrange(8, 80))]
        kind = rng.randrange(8)
        if kind == 0:
            body = [w.upper() + "!!" for w in body]
        elif kind == 1:
            body = [w for w in body[:8] for _ in range(6)]
        elif kind == 2:
            body = [x for w in body for x in (w, "|")]
        else:
            body[0] = body[0].title()
            body[-1] += "."
        texts.append(" ".join(body))
        labels.append(int(kind > 2))
    return texts, labels


def test_held_out_accuracy(spark, docs):
    texts, labels = corpus()
    space = qk.learn(docs(texts), spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, quality int"))
    rows = qk.score(docs(texts), space).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and held
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= qk.THRESHOLD) for r in rows)


def test_blocked_votes_equal_direct_votes():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((60, qk.DIMENSIONS))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 60).astype(float)
    space = qk.Space(np.ones(qk.TERMS), rng.standard_normal((qk.TERMS, qk.DIMENSIONS)), vectors, labels, 0.5)
    x = rng.random((qk.BLOCK + 30, qk.TERMS))
    got = space.vote(x)
    for i in (0, 7, qk.BLOCK, qk.BLOCK + 29):
        y = x[i] @ space.projection
        near = vectors @ (y / np.linalg.norm(y))
        best = np.argsort(-near)[:qk.NEIGHBOURS]
        w = np.maximum(near[best], 0) ** 4
        assert np.isclose(got[i], (w * labels[best]).sum() / w.sum())


def test_labels_of_held_out_rows_are_not_learned(spark, docs):
    texts, labels = corpus(60)
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, quality int")
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in enumerate(labels)],
                                  "doc_id bigint, quality int")
    a, b = qk.learn(docs(texts), table), qk.learn(docs(texts), other)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def test_empty_null_and_clashing(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    space = qk.learn(docs(["a"]), none)
    assert {r["score"] for r in qk.score(docs([None, "", "a b"]), space).collect()} == {0.5}
    assert qk.score(docs([]), space).count() == 0
    df = spark.createDataFrame([(None, "x y", 2, 3)], "doc_id bigint, text string, score int, held_out int")
    assert qk.score(df, space).count() == 1


def test_long_words_count_to_their_end():
    from measureloom.llm.quality_knn import Shapes, shape_of, terms

    plain, marked = "x" * 200, "x" * 100 + "7-" * 50
    assert shape_of(plain) == "al" and shape_of(marked) == "a" + "0-" * 50 + "l"
    assert (terms(plain, Shapes()) != terms(marked, Shapes())).any()
