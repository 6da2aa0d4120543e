"""Flatten results to path/value leaves and check claims, shown numbers and charts against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.functions.display import parse_shown
from measureloom.operators.onerow import attach

DEFAULT_TOLERANCE = 1e-9


def metrics_long(totals: DataFrame, rows: DataFrame | None = None,
                 units: DataFrame | None = None) -> DataFrame:
    """(path, value, unit, direction) for totals and, when given, ranked member rows.

    ``rows`` need a 1-based ``rank``; ``units`` has measure_id, unit and direction.
    """
    fields = ("current", "baseline", "change_abs", "change_pct")
    lines = totals.select("measure_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("leaf"), F.col(f).cast("double").alias("value"))
        for f in fields])).alias("l"))
    out = lines.select("measure_id", F.concat_ws(
        ".", F.lit("measure_results"), "measure_id", "l.leaf").alias("path"), "l.value")
    if rows is not None:
        member_fields = ("current", "baseline", "share", "change_pct", "delta", "contribution_pp")
        lines = rows.select(
            "measure_id", "dimension", "rank", F.explode(F.array(*[
                F.struct(F.lit(f).alias("leaf"), F.col(f).cast("double").alias("value"))
                for f in member_fields])).alias("l"))
        out = out.unionByName(lines.select("measure_id", F.concat_ws(
            ".", F.lit("measure_dimensions"), "measure_id", "dimension",
            (F.col("rank") - 1).cast("string"), "l.leaf").alias("path"), "l.value"))
    if units is None:
        return out.select("path", "value")
    return out.join(units.select("measure_id", "unit", "direction"), "measure_id", "left").select(
        "path", "value", "unit", "direction")


def flatten(df: DataFrame) -> DataFrame:
    """Numeric leaves of nested rows as (path, value).

    The schema is walked on the driver; every array level becomes a ``posexplode`` of the data, so
    the number of leaves is never limited. With more than one row, paths repeat per row.
    """
    leaves = [leaf for f in df.schema.fields
              for leaf in _walk(df, F.col(f"`{f.name}`"), f.dataType, F.lit(f.name))]
    if not leaves:
        return df.sparkSession.createDataFrame([], "path string, value double")
    return reduce(DataFrame.unionByName, leaves)


def _walk(df: DataFrame, c: Column, kind: T.DataType, path: Column) -> list[DataFrame]:
    if isinstance(kind, (T.NumericType, T.BooleanType)) and not isinstance(kind, T.BooleanType):
        return [df.select(path.alias("path"), c.cast("double").alias("value"))]
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields
                for leaf in _walk(df, c[f.name], f.dataType, F.concat_ws(".", path, F.lit(f.name)))]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        names = ["_at", "_item"] if isinstance(kind, T.ArrayType) else ["_at", "_key", "_item"]
        opened = df.select(path.alias("_path"), F.posexplode(c).alias(*names))
        at = F.col("_at" if isinstance(kind, T.ArrayType) else "_key").cast("string")
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        return _walk(opened, F.col("_item"), inner, F.concat_ws(".", F.col("_path"), at))
    return []


def unsupported_claims(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Claims whose evidence path does not exist or holds nothing; hypotheses are exempt."""
    filled = metrics.where(F.col("value").isNotNull()).select("path")
    needed = claims.where(F.col("kind") != "hypothesis")
    return needed.join(filled, "path", "left_anti")


def shown_numbers(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Check every shown number against its stored value.

    A number matches within half a unit of its last shown decimal. A value stored in 万 may be
    shown in 亿. Outcomes: match, no_number, several_numbers, no_value, mismatch.
    """
    shown = claims.withColumn("_p", parse_shown(F.col("text")))
    joined = shown.join(metrics.select("path", F.col("value").alias("stored")), "path", "left")
    in_yi = (F.col("_p.unit") == "亿") & F.col("path").rlike("_wan$")
    expected = F.when(in_yi, F.col("stored") / 1e4).otherwise(F.col("stored"))
    tolerance = F.pow(F.lit(10.0), -F.col("_p.decimals")) / 2 + DEFAULT_TOLERANCE
    outcome = (
        F.when(F.col("_p").isNull(), "no_number")
        .when(F.col("_p.count") != 1, "several_numbers")
        .when(F.col("stored").isNull(), "no_value")
        .when(F.abs(F.col("_p.value") - expected) > tolerance, "mismatch").otherwise("match"))
    return joined.select(*claims.columns, F.col("_p.value").alias("shown"),
                         expected.alias("expected"), outcome.alias("outcome"))


def assert_metrics(expected: DataFrame, metrics: DataFrame) -> DataFrame:
    """Expected (path, expect, tolerance) against stored values; ``ok`` per row."""
    joined = expected.join(metrics.select("path", "value"), "path", "left")
    close = F.abs(F.col("value") - F.col("expect")) <= F.coalesce(
        F.col("tolerance"), F.lit(DEFAULT_TOLERANCE))
    return joined.withColumn("ok", F.coalesce(close, F.lit(False)))


def diff_results(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths added, removed or changed between two result sets."""
    left = before.select("path", F.col("value").alias("before"), F.lit(True).alias("_l"))
    right = after.select("path", F.col("value").alias("after"), F.lit(True).alias("_r"))
    kind = (F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed")
            .when(~F.col("before").eqNullSafe(F.col("after")), "changed"))
    return (left.join(right, "path", "full").withColumn("kind", kind)
            .where(F.col("kind").isNotNull())
            .select("path", F.element_at(F.split("path", r"\."), 1).alias("category"), "kind",
                    "before", "after"))


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("category", "kind").agg(F.count(F.lit(1)).alias("changes"))


def series_aligned(series: DataFrame, name: str, at: str = "month") -> DataFrame:
    """Do all series cover exactly the same periods.

    A series is aligned when it covers every period that any series covers; only two counters per
    series are compared, no period sets are collected.
    """
    points = series.groupBy(name, at).agg(F.count(F.lit(1)).alias("_n"))
    per = points.groupBy(name).agg(F.count(F.lit(1)).alias("periods"))
    every = points.groupBy(at).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("all_periods"))
    return attach(per, every).withColumn(
        "aligned", F.col("periods") == F.col("all_periods"))


def chart_values(bindings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Chart points against stored values after transform and factor.

    Bindings: path, transform (identity, abs, negate), factor, tolerance, actual. Null matches
    only null; an unknown transform or path never matches.
    """
    joined = bindings.join(metrics.select("path", F.col("value"), F.lit(True).alias("_has")),
                           "path", "left")
    factor = F.coalesce(F.col("factor"), F.lit(1.0))
    expected = (F.when(F.col("transform") == "abs", F.abs("value"))
                .when(F.col("transform") == "negate", -F.col("value"))
                .when(F.coalesce("transform", F.lit("identity")) == "identity", F.col("value"))
                ) * factor
    known = F.col("_has").isNotNull() & F.coalesce("transform", F.lit("identity")).isin(
        "identity", "abs", "negate")
    close = F.abs(F.col("actual") - F.col("expected")) <= F.coalesce(
        F.col("tolerance"), F.lit(DEFAULT_TOLERANCE))
    both_null = F.col("actual").isNull() & F.col("expected").isNull()
    return (joined.withColumn("expected", expected)
            .withColumn("matched", known & (both_null | F.coalesce(close, F.lit(False))))
            .select(*bindings.columns, "expected", "matched"))


def number_coverage(claims: DataFrame) -> DataFrame:
    """Share of numeric claims that are bound to a path or exempted; 100 when there are none."""
    covered = F.col("bound") | F.col("exempt")
    n = claims.agg(F.count(F.lit(1)).alias("numbers"), F.count_if(F.col("bound")).alias("bound"),
                   F.count_if(~F.col("bound") & F.col("exempt")).alias("exempt"),
                   F.count_if(covered).alias("_c"))
    share = F.when(F.col("numbers") == 0, 100.0).otherwise(
        F.col("_c") / F.when(F.col("numbers") > 0, F.col("numbers")) * 100)
    return n.select("numbers", "bound", "exempt", share.alias("coverage_pct"))
