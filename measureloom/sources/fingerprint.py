"""Fingerprints of source bytes and of query text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measureloom.operators.onerow import attach

_CHUNK = 1 << 20
#: Bytes of a file that one task reads at once, and digests that are joined into one.
RANGE_BYTES, FANOUT = 64 << 20, 1024
CAVEAT = "covers the query text only; compare result fingerprints for changes of the data"


def _hash_ranges(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stream every byte range through SHA-256 in small chunks."""
        from urllib.parse import unquote

        from pyarrow import fs

        for frame in frames:
            digests = []
            for uri, nr in zip(frame["path"], frame["nr"], strict=True):
                plain = unquote(uri[len("file:"):]) if uri.startswith("file:") else None
                system, path = ((fs.LocalFileSystem(), plain) if plain else fs.FileSystem.from_uri(uri))
                digest, left = hashlib.sha256(), size
                with system.open_input_file(path) as stream:
                    stream.seek(int(nr) * size)
                    while left and (chunk := stream.read(min(_CHUNK, left))):
                        digest.update(chunk)
                        left -= len(chunk)
                digests.append(digest.hexdigest())
            yield frame.assign(sha256=digests)

    return run


def file_fingerprints(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(path, bytes, sha256) of every file under a path.

    File names come from the binary-file listing without its content column, which leaves out empty
    files. A file of one range has
    the plain SHA-256 of its bytes. A longer one has a tree digest: ranges of ``range_bytes`` are
    hashed by tasks of their own, and the hex digests of ``fanout`` neighbours are joined and hashed,
    a level at a time, until one is left; a group of one keeps its digest. Digests of one size of
    range and fan-out can be compared.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
               .select("path", F.col("length").alias("bytes")))
    ranges = listing.withColumn("nr", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.greatest(F.col("bytes") - 1, F.lit(0)) / range_bytes))))
    nodes = ranges.repartition("path", "nr").mapInPandas(
        _hash_ranges(range_bytes), "path string, bytes bigint, nr bigint, sha256 string")
    longest = listing.agg(F.max("bytes")).head()[0] or 0
    left = max(1, -(-longest // range_bytes))
    while left > 1:
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("nr", "sha256"))), lambda s: s["sha256"]))
        nodes = nodes.groupBy("path", "bytes", F.floor(F.col("nr") / fanout).alias("up")).agg(
            F.when(F.count(F.lit(1)) == 1, F.max("sha256")).otherwise(F.sha2(joined, 256)).alias("sha256")
        ).withColumnRenamed("up", "nr")
        left = -(-left // fanout)
    return nodes.select("path", "bytes", "sha256")


def combined(files: DataFrame) -> DataFrame:
    """One digest over all files: sorted per leading hex digits, then over those 4,096 parts."""
    parts = files.groupBy(F.substring("sha256", 1, 3).alias("p")).agg(
        F.sha2(F.concat_ws("", F.sort_array(F.collect_list("sha256"))), 256).alias("d"),
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    return parts.agg(
        F.sum("n").alias("files"), F.sum("b").alias("bytes"),
        F.sha2(F.concat_ws("", F.transform(
            F.sort_array(F.collect_list(F.struct("p", "d"))), lambda s: s["d"])), 256)
        .alias("sha256"))


def source_fingerprint(spark: SparkSession, path: str, selector: str | None = None,
                       range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row: kind, name, files, bytes, sha256, scope; a single file keeps its own digest."""
    import os

    files = file_fingerprints(spark, path, range_bytes, fanout)
    both = attach(combined(files), files.agg(F.max("sha256").alias("own")))
    return both.select(
        F.lit(os.path.splitext(path)[1].lstrip(".").lower() or "file").alias("kind"),
        F.lit(os.path.basename(path.rstrip("/"))).alias("name"),
        F.lit(selector).cast("string").alias("selector"), "files", "bytes",
        F.when(F.col("files") == 1, F.col("own")).otherwise(F.col("sha256")).alias("sha256"),
        F.lit("source_file_snapshot").alias("fingerprint_scope"))


def sql_fingerprint(spark: SparkSession, text: str) -> DataFrame:
    """One row for a query source; the text itself is not stored."""
    return spark.range(1).select(
        F.lit("inline-sql").alias("kind"),
        F.lit(hashlib.sha256(text.encode("utf-8")).hexdigest()).alias("sha256"),
        F.lit("query_text_only").alias("fingerprint_scope"), F.lit(CAVEAT).alias("caveat"))
