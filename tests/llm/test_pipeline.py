"""The whole pipeline on the smallest tables against plain code per stage."""

import os
import shutil
import sys

import pytest

from measureloom.llm import secrets, toxicity

from test_decontaminate import expected as contamination
from test_jaccard_join import sets

SF_DIR = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


def test_stages_in_order(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "decontamination", "secret_scan", "mixing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        now = {r["doc_id"]: r for r in rows}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(rows) == len(now)
        if name == "toxicity":
            chain = toxicity.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            p = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(spark.read.parquet(f"{SF_DIR}/documents.parquet"), chain).collect()}
            assert set(now) == {k for k in before if p[k] < toxicity.THRESHOLD}
        if name == "ngram_jaccard_join":
            ids = sorted(before)
            found = dict(zip(ids, sets([before[i]["text"] for i in ids]), strict=True))
            low = {i: i for i in ids}
            changed = True
            while changed:
                changed = False
                for a in ids:
                    for b in ids:
                        both = len(found[a] & found[b]) if a < b else 0
                        if both and 100 * both >= 75 * len(found[a] | found[b]) and low[a] != low[b]:
                            low[a] = low[b] = min(low[a], low[b])
                            changed = True
            assert set(now) == {i for i in ids if low[i] == i}
        if name == "decontamination":
            assert set(now) == {k for k in before if not contamination(before[k]["text"], items)[3]}
        if name == "secret_scan":
            assert set(now) == set(before)
            assert all(now[k]["text"] == secrets.masked(before[k]["text"]) for k in now)
            assert all(now[k]["n_chars"] == len(now[k]["text"]) for k in now)
        if name == "mixing":
            assert {k for k in now} <= set(before) and len(rows) >= len(now)
        before = now


def awkward(spark, folder, texts, ids):
    """A folder of tables with few or no rows, and the documents in it."""
    rows = [(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and null ids pass; only linked documents go."""
    folder = str(tmp_path)
    texts = [None, "", "a b c", "a b c", "a b c", "x" * 50_000, "token=abcdef1"]
    docs = awkward(spark, folder, texts, [0, 1, 2, 2, 3, None, 5])
    sizes = []
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        sizes.append(docs.count())
    assert sizes == [5, 5, 5, 5]  # one of the three equal texts stays; texts without tokens come with their block
    assert {r["text"] for r in docs.collect()} == {None, "", "a b c", "x" * 50_000, "[SECRET]"}


def test_stages_take_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    docs = awkward(spark, folder, [], [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if name == "mixing" else out.select(docs.columns)


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the subpackage and the pipeline still lists the other queries."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "measureloom"), tmp_path / "measureloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_batches_of_whole_texts_are_light(spark, docs):
    from measureloom.llm import jaccard_join

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    steps = [lambda d: jaccard_join.link(d), lambda d: secrets.redact(d), lambda d: toxicity.score(d, toxicity.Chain((), (), ()))]
    try:
        for step in steps:
            spark.conf.set(name, "10000")
            step(docs(["a b c d e f", None]))
            assert int(spark.conf.get(name)) <= 1000
        spark.conf.set(name, "7")
        steps[1](docs(["a"]))
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
