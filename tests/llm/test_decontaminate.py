"""Window hits against plain code."""

import random
import re

from pyspark.sql import functions as F

from measureloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def expected(text, items, n=13):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        size = min(n, len(b))
        for k in range(len(b) - size + 1) if b else ():
            for at in range(len(w) - size + 1):
                if w[at:at + size] == b[k:k + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def cases(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Größe", "É", "9"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 13, 20, 30])))) for k in range(12)]
    items += [(50, None), (51, "..."), (52, items[4][1]), (7, "one")]
    texts = [None, "", "?!", "one", "ONE two"]
    for _ in range(25):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 400]))]
        for _, t in rng.sample(items[:12], 2):
            t = t.split()
            cut = rng.randrange(len(t))
            body[rng.randrange(len(body)):0] = t if rng.random() < 0.6 else t[cut:]
        texts.append(", ".join(body).upper())
    return items, texts


def test_against_plain_code(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 64)
    items, texts = cases()
    got = dc.scan(docs(texts), bench(spark, items)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == expected(texts[r["doc_id"]], items)


def test_the_same_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "MAX_BROADCAST_WINDOWS", 0)
    items, texts = cases(5)
    for r in dc.scan(docs(texts), bench(spark, items)).collect():
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == expected(texts[r["doc_id"]], items)


def test_repeated_rows_each_get_theirs(spark, docs):
    text = " ".join(f"w{k}" for k in range(20))
    got = dc.expand(dc.scan(docs([text, text, text, "x"], ids=[1, 1, None, None]), bench(spark, [(0, text)]))).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in got) == [("1", 20), ("1", 20), ("None", 0), ("None", 20)]


def test_empty_tables(spark, docs):
    assert dc.scan(docs([]), bench(spark, [(0, "a b")])).count() == 0
    assert [r["n_hit"] for r in dc.scan(docs(["a b"]), bench(spark, [])).collect()] == [0]


def test_documents_or_spans_go(spark, docs):
    item = " ".join(f"q{k}" for k in range(13))
    texts = [f"Before, {item}; after.", "clean text", None, " ".join(["z"] * 400) + " " + item]
    benchmark = bench(spark, [(0, item)])
    kept = dc.decontaminate(docs(texts), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert kept.columns == docs(texts).columns
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs(texts), benchmark, mode="spans").collect()}
    assert cut[0] == "Before; after." and cut[1] == "clean text" and cut[2] is None and cut[3] == " ".join(["z"] * 400)


def test_clashing_columns_and_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id bigint, text string, at string, size int, window int").withColumn("n_words", F.lit(9))
    found = dc.scan(df, bench(spark, [(0, "a b")]))
    assert [r["n_hit"] for r in found.collect()] == [2]
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert dc.decontaminate(df, bench(spark, [(0, "z")])).columns == df.columns
