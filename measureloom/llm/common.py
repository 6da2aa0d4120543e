"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Key sets up to this many rows may be broadcast (16 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000

#: Rows of a batch that Spark hands to Python. Its own 10,000 whole texts are tens of MB, held in the JVM and in each
#: worker at once, and more while their buffers grow by doubling.
BATCH_ROWS = 1000
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_MASK = (1 << 63) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xFF51AFD7ED558CCD], dtype=np.uint64)
_UNDO = np.array([pow(int(_ODD[k]), -1, 1 << 64) for k in (3, 4)], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names, or, in a local session without one, one set here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder, of so many files at most if given.

    For loops: a checkpoint keeps what the optimizer inferred about its columns, which a loop doubles
    in every round until planning takes minutes; a table starts afresh.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def light_batches(spark: SparkSession) -> None:
    """Bound the batches of whole texts in this session; a smaller bound that is set stays. Results do not depend on it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the action that wrote them ends: for steps that leave their results in tables."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that their Python values do not all exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def small_enough(keys: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The keys, marked for broadcast if a count shows that they keep to the bound."""
    return F.broadcast(keys) if keys.count() <= bound else keys


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart when ids are missing or repeated."""
    return [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())]


class WordHashes(dict):
    """63-bit hash of each word seen, emptied when it grows beyond its bound."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) & _MASK
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.__getitem__
        return np.fromiter(map(get, words), np.int64, len(words)).view(np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit values."""
    values = values ^ (values >> np.uint64(32))
    values = values * _ODD[3]
    values = values ^ (values >> np.uint64(29))
    values = values * _ODD[4]
    return values ^ (values >> np.uint64(32))


def unmix(values: np.ndarray) -> np.ndarray:
    """The values that ``mix`` made these of."""
    values = values ^ (values >> np.uint64(32))
    values = values * _UNDO[1]
    values = values ^ (values >> np.uint64(29)) ^ (values >> np.uint64(58))
    values = values * _UNDO[0]
    return values ^ (values >> np.uint64(32))


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a lower-cased text; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    size = min(width, len(h))
    if len(h) < width:
        return mix((h * _multipliers(size)).sum(dtype=np.uint64, keepdims=True)
                   + np.uint64(size * 0x51ED27))
    m, count = _multipliers(width), len(h) - width + 1
    total = h[:count] * m[0]
    for k in range(1, width):
        total += h[k:k + count] * m[k]
    return np.unique(mix(total))


def _multipliers(n: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=np.uint64)
    return (mix(steps * _ODD[0]) | np.uint64(1))
