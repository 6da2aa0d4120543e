"""Toxicity by a chain of linear classifiers over words.

Categories are predicted in order. The model of a category sees the words of a text and the
probabilities of all categories before it; in training those are out-of-fold predictions, so that a
later model learns how far an earlier one can be trusted on texts it has not seen.

Training uses a bounded sample of labelled rows, without near copies, so that one mislabelled text that
was copied often does not teach its rare words. Words are chosen by their association with any category.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, light_batches, mix, reliable, shingle_set, small
from .logistic import Sparse, fit, sigmoid

WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Labelled rows that train the chain at most, and words it may use.
MAX_ROWS, MAX_WORDS = 12_000, 600
#: A word needs this many distinct labelled texts, and this association (a z value), to be used.
MIN_TEXTS, MIN_Z = 6, 4.0
#: Words longer than this many bytes are no features.
LONGEST_WORD = 40
#: Beginnings of words, in characters, that are features beside the words: toxic stems take endings.
STEMS = (4, 5, 6, 7, 8)
FOLDS = 3
#: Probability of the last category from which a text is toxic.
THRESHOLD = 0.4

# Seed words that split the toxic rows into the first categories of the chain.
INSULTS = ("clown", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "scum", "trash", "vermin")
CONTEMPT = ("disgusting", "dumb", "filthy", "pathetic", "repulsive", "stupid", "useless", "vile", "worthless")


@dataclass(frozen=True)
class Chain:
    """A fitted chain: category names, words, and one weight vector per category."""

    names: tuple[str, ...]
    words: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]

    def predict(self, rows: list) -> np.ndarray:
        """Probabilities, one column per category, of rows of word indices."""
        found = np.zeros((len(rows), len(self.names)))
        for k, w in enumerate(self.weights):
            x = Sparse(rows, len(self.words), found[:, :k])
            found[:, k] = sigmoid(x.dot(np.array(w)))
        return found


def words_of(text: str | None) -> set[bytes]:
    return set(WORD.findall((text or "").lower().encode("utf-8", "replace")))


def features_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def default_categories(toxic: Column, words: Column) -> list[tuple[str, Column]]:
    """Insults, contempt, and toxicity itself, from one label and the seed words."""
    has = lambda seeds: F.arrays_overlap(words, F.array(*map(F.lit, seeds)))
    return [("insult", toxic & has(INSULTS)), ("contempt", toxic & has(CONTEMPT)), ("toxic", toxic)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and four minima of hashed shingles, which agree for near copies."""
    hashes = WordHashes()
    salts = mix(np.arange(1, 5, dtype=np.uint64))
    for batch in small(batches):
        words, minima = [], []
        for text in batch.column(1).to_pylist():
            words.append(sorted(w.decode("utf-8", "replace") for w in words_of(text) if len(w) <= LONGEST_WORD))
            s = shingle_set((text or "").encode("utf-8", "replace"), hashes)
            minima.append([int(mix(s ^ k).min() >> np.uint64(1)) for k in salts] if len(s) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.string())),
             pa.array(minima, pa.list_(pa.int64()))], ["key", "toxic", "words", "minima"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", categories=default_categories, max_rows: int = MAX_ROWS) -> Chain:
    """Fit the chain on at most ``max_rows`` labelled rows, chosen by a hash of their ids.

    Rows without a label or id are not used; an id with several labels counts as toxic if any says so.
    Without labelled rows every probability is that of an empty training set.
    """
    light_batches(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_l")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).orderBy(
        F.xxhash64("_l"), "_l").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("_i") == F.col("_l")).select(F.xxhash64("_i", "text").alias("key"), "text", "toxic")
    rows = reliable(sample.mapInArrow(_describe, "key bigint, toxic int, words array<string>, minima array<bigint>"))
    groups = rows.select("key", F.posexplode("minima").alias("k", "m"))
    first = groups.groupBy("k", "m").agg(F.min("key").alias("lead"))
    copies = groups.join(first, ["k", "m"]).where("lead < key").select("key").distinct()
    named = categories(F.col("toxic") == 1, F.col("words"))
    names = tuple(n for n, _ in named)
    kept = reliable(rows.dropDuplicates(["key"]).join(copies, "key", "left_anti").select(
        "key", "words", *[c.cast("int").alias(f"y_{n}") for n, c in named]))
    totals = kept.agg(F.count("*").alias("n"), *[F.sum(f"y_{n}").alias(n) for n in names]).first()
    n = totals["n"]
    if not n:
        return Chain(names, (), tuple((0.0,) * (k + 1) for k in range(len(names))))
    marks = [f"y_{c}" for c in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            ys = list(zip(*[batch.column(k + 1).to_pylist() for k in range(len(marks))], strict=True))
            for words, y in zip(batch.column(0).to_pylist(), ys, strict=True):
                for f in {f for w in words for f in features_of(w)}:
                    old = found.setdefault(f, [0] * (len(marks) + 1))
                    old[0] += 1
                    for k, v in enumerate(y):
                        old[k + 1] += v
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), *[pa.array(c) for c in zip(*found.values(), strict=True)]],
                                             ["word", "df", *names])

    per = kept.select("words", *marks).mapInArrow(count, ", ".join(
        ["word string", "df bigint", *[f"{c} bigint" for c in names]])).groupBy("word").agg(
        F.sum("df").alias("df"), *[F.sum(c).alias(c) for c in names]).where(F.col("df") >= MIN_TEXTS)
    share = {c: (totals[c] or 0) / n for c in names}
    z = [F.abs(F.col(c) - F.col("df") * share[c]) / F.sqrt(F.col("df") * max(share[c] * (1 - share[c]), 1e-9))
         for c in names]
    z = F.greatest(*z) if len(z) > 1 else z[0]
    best = per.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(MAX_WORDS)
    words = sorted(r["word"] for r in best.select("word").collect())
    index = Index(words)

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = [index.of(w.encode() for w in r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(used, pa.list_(pa.int32())), *batch.columns[2:]],
                                             ["key", "used", *marks])

    table = kept.mapInArrow(indices, ", ".join(["key bigint", "used array<int>", *[f"{m} int" for m in marks]])).toArrow()
    order = np.argsort(table["key"].to_numpy())
    features = table["used"].to_pylist()
    features = [features[i] for i in order]
    fold = (mix(table["key"].to_numpy()[order].view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    earlier, weights = np.zeros((len(features), 0)), []
    for c in names:
        y = table[f"y_{c}"].to_numpy()[order].astype(float)
        x = Sparse(features, len(words), earlier)
        out = np.full(len(y), y.mean())
        for k in range(FOLDS):
            if (fold != k).any() and (fold == k).any():
                out[fold == k] = sigmoid(x.take(fold == k).dot(fit(x.take(fold != k), y[fold != k])))
        weights.append(tuple(fit(x, y).tolist()))
        earlier = np.column_stack([earlier, out])
    return Chain(names, tuple(words), tuple(weights))


class Index(dict):
    """Indices of the features that each word seen has, emptied when it grows beyond its bound."""

    LIMIT = 100_000

    def __init__(self, features: Sequence[str]):
        super().__init__()
        self.features = {f: i for i, f in enumerate(features)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        found = () if len(word) > LONGEST_WORD else tuple(
            self.features[f] for f in features_of(word.decode("utf-8", "replace")) if f in self.features)
        self[word] = found
        return found

    def of(self, words) -> list[int]:
        return sorted({i for w in words for i in self[w]})


def _rows(texts: Sequence[str | None], index: Index) -> list[list[int]]:
    return [index.of(words_of(t)) for t in texts]


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: the id and p_<category> for every category, in chain order.

    Null and empty texts have no words and get the chain's probabilities of a text without any; whole
    texts are read; repeated rows and null ids are rows like any other; other columns are ignored.
    """
    light_batches(docs.sparkSession)
    words = chain.words
    names = ["id", *[f"p_{c}" for c in chain.names]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(words)
        for batch in small(batches):
            p = chain.predict(_rows(batch.column(1).to_pylist(), index))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in p.T]], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, ", ".join([f"id {kind}", *[f"{c} double" for c in names[1:]]])).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they were, whose last category stays below the threshold."""
    light_batches(docs.sparkSession)
    words = chain.words
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(words)
        for batch in small(batches):
            p = chain.predict(_rows(batch.column(at).to_pylist(), index))
            yield batch.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
