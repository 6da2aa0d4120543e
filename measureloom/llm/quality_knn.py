"""Quality of texts by nearest-neighbour voting in a latent semantic space.

Terms are the shapes of words, pairs of shapes, and repetitions of words; they are weighted by
frequency and rarity and projected to a few latent dimensions, learned from a bounded sample of
labelled rows. The labelled vectors travel to every task; every document is compared with all of them
in blocks of exact cosine products, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned and vote at most: 33 doubles each to every task.
MAX_ROWS = 4_000
DIMENSIONS, NEIGHBOURS, BLOCK = 32, 15, 512
#: Hashed terms: single shapes, pairs of shapes, and the named ones after them.
SHAPES, PAIRS = 512, 1024
NAMED = ("again", "again after one", "new", "one word", "few words")
TERMS = SHAPES + PAIRS + len(NAMED)
#: Share of label 1 from which a text is predicted to have it.
THRESHOLD = 0.3


def shape_of(word: str) -> str:
    """Classes of the characters of a word, runs made one: capitals, letters, digits, marks as they are."""
    out = []
    for c in word:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    size = "1" if len(word) == 1 else "s" if len(word) < 4 else "m" if len(word) < 16 else "l"
    return "".join(out) + size


class Shapes(dict):
    """Hashed shape of each word seen, emptied when it grows beyond its bound; long words are not kept."""

    LIMIT, LONG = 100_000, 64

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = zlib.crc32(shape_of(word).encode("utf-8", "replace")) & 0x7FFFFFFF
        if len(word) <= self.LONG:
            self[word] = found
        return found


def terms(text: str | None, shapes: Shapes) -> np.ndarray:
    """Relative frequencies of the terms of a whole text, as square roots; zeros without words."""
    out = np.zeros(TERMS)
    words = (text or "").split()
    n = len(words)
    if not n:
        return out
    s = np.fromiter(map(shapes.__getitem__, words), np.int64, n)
    out[:SHAPES] = np.bincount(s % SHAPES, minlength=SHAPES)
    if n > 1:
        out[SHAPES:SHAPES + PAIRS] = np.bincount((s[:-1] * 31 + s[1:]) % PAIRS, minlength=PAIRS)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    after = sum(a == b for a, b in zip(words, words[2:], strict=False))
    out[SHAPES + PAIRS:] = (4 * again, 4 * after, len(set(words)) / 4, n * (n == 1), n * (1 < n < 8) / 4)
    return np.sqrt(out / n)


@dataclass(frozen=True)
class Space:
    """Weights of terms, the projection, unit vectors of the labelled rows, their labels and share of 1."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def place(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; rows without terms stay zero."""
        y = (x * self.weights) @ self.projection
        norm = np.sqrt((y * y).sum(1, keepdims=True))
        return np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-12)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours, every row compared with all."""
        out = np.full(len(x), self.share)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x), BLOCK):
            y = self.place(x[at:at + BLOCK])
            near = y @ self.vectors.T
            best = np.argpartition(near, -k, axis=1)[:, -k:] if k < near.shape[1] else np.argsort(near, axis=1)
            weight = np.maximum(np.take_along_axis(near, best, 1), 0) ** 4
            total = weight.sum(1)
            votes = (weight * self.labels[best]).sum(1)
            out[at:at + len(y)] = np.where(total > 0, votes / np.where(total > 0, total, 1), self.share)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id):
    """Whether a row takes no part in learning: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_ROWS) -> Space:
    """The space of at most ``max_rows`` labelled rows that are not held out, chosen by a hash of their ids.

    Rows without id or label are not used; an id with several labels counts as 0 if any says so.
    Without labelled rows every text scores 0.5.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("_l")).agg(F.min(F.col(label_col).cast("int")).alias("label")).orderBy(
        F.xxhash64("_l"), "_l").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("_i") == F.col("_l")).select("_i", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            raw = [terms(t, shapes).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(raw, pa.binary()), batch.column(2)],
                                             ["id", "terms", "label"])

    table = sample.mapInArrow(run, "id string, terms binary, label int").orderBy("id", "terms").limit(max_rows).toArrow()
    y = table["label"].to_numpy().astype(float)
    x = np.frombuffer(b"".join(table["terms"].to_pylist()), np.float32).reshape(-1, TERMS).astype(float)
    if not len(y):
        none = np.zeros((TERMS, DIMENSIONS))
        return Space(np.ones(TERMS), none, np.zeros((0, DIMENSIONS)), y, 0.5)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0)))
    weights = np.maximum(weights, 0.25)
    _, axes = np.linalg.eigh((x * weights).T @ (x * weights))
    space = Space(weights, axes[:, ::-1][:, :DIMENSIONS].copy(), np.zeros((0, DIMENSIONS)), y, float(y.mean()))
    return Space(weights, space.projection, space.place(x), y, float(y.mean()))


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: the id, held_out, score and predicted.

    Scores come from the whole text alone. Null and empty texts, and others without any similarity, get
    the share of label 1 in the sample. Repeated rows and null ids are rows like any other; an empty
    table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, s = Shapes(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.stack([terms(t, shapes) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s.vote(x))],
                                                 ["id", "held_out", "score"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return found.mapInArrow(run, f"id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed("id", id_col)
