"""Row numbers within groups of any size, by column functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, small_enough


def before(rows: DataFrame, group: Sequence[str], order: Sequence[str], into: str,
           weight: str | None = None) -> DataFrame:
    """The rows with, as `into`, how many come before them in their group, nulls first.

    With a weight column, rows stand for that many and the weights before are summed. `group` and
    `order` together have to tell rows apart; aggregate equal rows to a weight first. Sorted ranges
    of (group, order) are written once, numbered locally, and shifted by what the same group holds in
    earlier ranges, so a group that holds most rows is spread over many tasks. A range border cuts one
    group at most, so the shifts are no more than there are ranges.
    """
    keys = [*group, *order]
    size = F.col(weight) if weight else F.lit(1)
    ranged = rows.repartitionByRange(*keys) if keys else rows
    ranged = reliable(ranged.withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy(*group, "_range").agg(F.sum(size).alias("_n")).select(
        *[F.col(g).alias(f"_shift_{k}") for k, g in enumerate(group)], F.col("_range").alias("_shift_range"),
        F.sum("_n").over(earlier).alias("_shift")).where("_shift > 0")
    inside = Window.partitionBy("_range", *group).orderBy(*[F.col(k).asc_nulls_first() for k in order])
    local = ranged.withColumn("_local", F.coalesce(
        F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("_range") == F.col("_shift_range")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_shift_{k}"))
    return local.join(small_enough(shifts), same, "left").select(
        *rows.columns, (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("long").alias(into))


#: Repeats that one task writes out of one row.
REPEATS = 65_536


def repeated(rows: DataFrame, times: str, into: str) -> DataFrame:
    """Every row as often as its `times` column says, numbered from 0 in `into`.

    Rows repeated more than REPEATS times are cut into blocks that are dealt out anew.
    """
    few = rows.where(F.col(times) <= REPEATS).withColumn(into, F.explode(F.sequence(
        F.lit(0).cast("long"), F.col(times) - 1)))
    blocks = rows.where(F.col(times) > REPEATS).withColumn("_from", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col(times) - 1, F.lit(REPEATS).cast("long"))))
    blocks = blocks.repartition("_from", *rows.columns)
    many = blocks.withColumn(into, F.explode(F.sequence(
        F.col("_from"), F.least(F.col("_from") + REPEATS, F.col(times)) - 1)))
    return few.unionByName(many.drop("_from"))
