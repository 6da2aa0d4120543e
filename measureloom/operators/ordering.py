"""Ranks and running totals over groups of any size.

A window ordered over a whole dimension would sort every member in one task. Here the rows are
range-partitioned on the full order (the name breaks ties, so even a group of equal values splits),
written once, and each segment is finished locally with an offset from the earlier segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measureloom.session import cut_lineage

_ROW_BITS = (1 << 33) - 1


def segmented(df: DataFrame, group: Sequence[str], order: Sequence[Column],
              segments: int | None = None) -> DataFrame:
    """Sort by (group, order) across segments and stamp ``_segment`` and ``_row``."""
    spark = df.sparkSession
    count = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g).asc() for g in group], *order]
    stamped = (df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
               .withColumn("_segment", F.spark_partition_id())
               .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))))
    return cut_lineage(stamped)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rank",
           running: dict[str, str] | None = None, segments: int | None = None) -> DataFrame:
    """Add a 1-based ``rank`` within each group and running sums ``{new column: summed column}``.

    ``order`` has to be total within a group for the rank to be reproducible.
    """
    group, running = list(group), running or {}
    rows = segmented(df, group, order, segments)
    at = [*group, "_segment"]
    pieces = rows.groupBy(*at).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"),
        *[F.sum(source).alias(f"_s_{new}") for new, source in running.items()])
    # One row per (group, segment): as many as segments plus groups.
    before = W.partitionBy(*group).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        *at, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"),
        *[F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0.0)).alias(f"_o_{new}")
          for new in running])
    keyed = [F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in group]
    left = rows.withColumn("_g", F.concat_ws("\1", F.lit(""), *keyed))
    right = pieces.withColumn("_g", F.concat_ws("\1", F.lit(""), *keyed)).drop(*group)
    joined = left.join(right, ["_g", "_segment"])
    joined = joined.withColumn(
        rank, (F.col("_skip") + F.col("_row") - F.col("_first") + 1).cast("bigint"))
    inside = W.partitionBy("_g", "_segment").orderBy("_row").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    for new, source in running.items():
        joined = joined.withColumn(new, F.col(f"_o_{new}") + F.sum(source).over(inside))
    return joined.select(*df.columns, rank, *running)
