"""Bring the columns of one-row results next to the rows of another result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, *one_rows: DataFrame) -> DataFrame:
    """Add every column of each one-row DataFrame as a scalar subquery.

    The row is computed once and becomes a literal of the outer plan, so no join is planned. More
    than one row is a runtime error; no row gives nulls.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    for i, one in enumerate(one_rows):
        packed = one.select(F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias("_one"))
        df = df.withColumn(f"_one{i}", packed.scalar())
        columns += [F.col(f"_one{i}")[c].alias(c) for c in one.columns]
    return df.select(*columns)


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join on keys, or attach a one-row right side when there are none."""
    return left.join(right, list(by)) if by else attach(left, right)
