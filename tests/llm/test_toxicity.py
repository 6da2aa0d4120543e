"""The chain on invented texts with planted words."""

import random

import numpy as np

from measureloom.llm import logistic, toxicity as tx

LETTERS = str.maketrans("0123456789", "abcdefghij")


def corpus(spark, docs, n=900, seed=2):
    rng = random.Random(seed)
    words = [f"wort{k}" for k in range(300)]
    texts, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            stems = [f"zork{rng.randrange(60)}x".translate(LETTERS) for _ in range(3)]  # one stem, many endings
            for w in rng.sample(["Idiot", "moron!", "pathetic", "WORTHLESS", *stems], rng.choice([1, 1, 2, 3])):
                body.insert(rng.randrange(len(body)), w)
        texts.append(" ".join(body))
        labels.append((i, int(toxic)))
    return docs(texts), spark.createDataFrame(labels, "doc_id bigint, toxic int"), [bool(y) for _, y in labels]


def test_held_out_accuracy_and_stems(spark, docs):
    table, labels, truth = corpus(spark, docs)
    chain = tx.train(table, labels.where("doc_id % 2 = 0"))
    assert chain.names == ("insult", "contempt", "toxic") and [len(w) - len(chain.words) for w in chain.weights] == [1, 2, 3]
    got = {r["doc_id"]: r for r in tx.score(table, chain).collect()}
    held = [k for k in got if k % 2]
    right = sum((got[k]["p_toxic"] >= tx.THRESHOLD) == truth[k] for k in held)
    assert right >= 0.98 * len(held)
    fresh = docs(["zorkfremd in wort1 wort2", "wort1 wort2 wort3", "wort1 " * 20_000 + "idiot", None, ""])
    p = {r["doc_id"]: r["p_toxic"] for r in tx.score(fresh, chain).collect()}
    assert p[0] > tx.THRESHOLD > p[1] and p[2] > tx.THRESHOLD and p[3] == p[4] < tx.THRESHOLD
    kept = tx.keep_clean(table, chain)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in got if got[k]["p_toxic"] < tx.THRESHOLD}


def test_the_chain_is_reproducible_and_bounded(spark, docs):
    table, labels, _ = corpus(spark, docs, 200)
    assert tx.train(table, labels, max_rows=100) == tx.train(table, labels, max_rows=100)


def test_no_labels_no_rows_nulls_and_clashing_columns(spark, docs):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    chain = tx.train(docs(["a", "b"]), none)
    assert {r["p_toxic"] for r in tx.score(docs(["a", None]), chain).collect()} == {0.5}
    assert tx.score(docs([]), chain).count() == 0 and tx.keep_clean(docs([]), chain).count() == 0
    df = spark.createDataFrame([(1, "x", 2, 3, 4)], "doc_id bigint, text string, toxic int, key int, id int")
    chain = tx.train(df, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert tx.score(df, chain).count() == 1


def test_logistic_regression_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(200)]
    y = np.array([float(0 in r and rng.random() < 0.9) for r in rows])
    x = logistic.Sparse(rows, 6)
    w = logistic.fit(x, y, ridge=1.0)
    gradient = x.tdot(logistic.sigmoid(x.dot(w)) - y) + np.r_[w[:-1], 0]
    assert np.abs(gradient).max() < 1e-2
