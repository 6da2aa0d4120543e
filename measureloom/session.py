"""Session settings and lineage cuts shared by every plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings the plans rely on. Shuffle partitions are left to adaptive execution: start high, let
# it coalesce, and let it split skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Copies that cut a lineage go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(threads: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{threads}]").appName("measureloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(threads)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written copy.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a session without it
    (a local test) gets a folder of its own.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Column types that a Parquet table gives back as they were.
_STORED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def written_table(df: DataFrame) -> DataFrame:
    """Write a large ``df`` that is read many times as a table in the same folder.

    Each reader then scans only its columns and the row groups its filter leaves. A frame with
    columns of other types is checkpointed instead. The folder goes with the application's.
    """
    if not df.columns or not all(
            isinstance(f.dataType, _STORED) or type(f.dataType) is T.StringType for f in df.schema.fields):
        return cut_lineage(df)
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    stored = [f"c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*stored)
    flat.write.parquet(path)
    read = df.sparkSession.read.schema(flat.schema).parquet(path)
    return read.select(*[F.col(c).alias(f.name) for c, f in zip(stored, df.schema.fields, strict=True)])
