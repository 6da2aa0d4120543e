"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measureloom.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from measureloom.llm.common import reliable, small_enough, table

#: The fitted chain and the links of documents have no SQL; tests compare with plain code instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles, the one with the smallest id stays.

    Documents without words, and without an id, stay; of rows that repeat id and text one stays.
    """
    found = reliable(jaccard_join.link(docs))
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(small_enough(gone.distinct()), F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return kept
    twice = small_enough(reliable(twice))
    alone = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti")
    again = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi").withColumn("_text", F.xxhash64("text"))
    return alone.unionByName(again.dropDuplicates(["doc_id", "_text"]).drop("_text"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, its length kept true."""
    return secrets.redact(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources."""
    return mixing.mix(docs, target_entropy=0.98, max_repeats=4.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each result written as Parquet and read again."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
