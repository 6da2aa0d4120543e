"""Trend tests, anomalies, concentration indices and the problem list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measureloom.contract import Measure, primary_of
from measureloom.functions.special import two_sided_p
from measureloom.operators.compare import measure_attribute, yoy_series
from measureloom.operators.onerow import attach, join_by
from measureloom.operators.shape import regular_months

SIGNIFICANCE = 0.05


def mann_kendall(series: DataFrame, by: Sequence[str], at: str = "month",
                 value: str = "value") -> DataFrame:
    """Mann–Kendall trend test of every series.

    A series holds one point per calendar period, so its length is bounded by the calendar and the
    ordered values fit one row; the pair signs are summed inside that row and no pairs are ever
    emitted. Below four points, or when all points are equal, the test is insufficient; below
    eight only the direction is given.
    """
    by = list(by)
    points = series.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(value)))),
                    lambda p: p[value]).alias("_x"))
    ties = (series.where(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.count(F.lit(1)).alias("_t")).groupBy(*by)
            .agg(F.sum(F.col("_t") * (F.col("_t") - 1) * (2 * F.col("_t") + 5)).alias("_ties")))
    x, n = F.col("_x"), F.size("_x").cast("bigint")

    def earlier_signs(v: Column, i: Column) -> Column:
        return F.aggregate(
            F.slice(x, F.lit(1), i), F.lit(0).cast("bigint"),
            lambda total, u: total + F.when(v > u, 1).when(v < u, -1).otherwise(0))

    score = F.aggregate(F.transform(x, earlier_signs), F.lit(0).cast("bigint"),
                        lambda total, s: total + s)
    scored = join_by(points, ties, by).select(
        *by, n.alias("n"), score.alias("_s"),
        ((n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18).alias("_var"))
    return trend_verdict(scored, by)


def trend_verdict(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """z, p, direction and significance from (n, _s, _var)."""
    tested = (F.col("n") >= 4) & (F.col("_var") > 0)
    z = (F.when(F.col("_s") > 0, (F.col("_s") - 1) / F.sqrt("_var"))
         .when(F.col("_s") < 0, (F.col("_s") + 1) / F.sqrt("_var")).otherwise(0.0))
    out = scored.select(
        *by, "n", F.when(tested, F.col("_s")).alias("s"),
        F.when(tested, F.col("_var")).alias("var_s"), F.when(tested, z).alias("z"),
        F.when(~tested, "insufficient_sample").when(F.col("_s") > 0, "increasing")
        .when(F.col("_s") < 0, "decreasing").otherwise("no_trend").alias("direction"))
    p = F.least(two_sided_p(F.col("z")), F.lit(1.0))
    return (out.withColumn("p", p)
            .withColumn("significant", F.coalesce(
                (F.col("n") >= 8) & (F.col("p") < SIGNIFICANCE), F.lit(False)))
            .select(*by, "n", "s", "var_s", "z", "p", "direction", "significant"))


def robust_z(series: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Median/MAD z score of every point; mean absolute deviation when the MAD is zero.

    Series have one point per calendar period, so exact medians are safe here.
    """
    by = list(by)

    centre = series.groupBy(*by).agg(F.median(value).alias("_med"))
    off = join_by(series, centre, by).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    spread = off.groupBy(*by).agg(F.median("_off").alias("_mad"), F.avg("_off").alias("_aad"))
    gap = F.col(value) - F.col("_med")
    z = (F.when(F.col("_mad") != 0, 0.6745 * gap / F.col("_mad"))
         .when(F.col("_aad") != 0, gap / (1.2533 * F.col("_aad"))).otherwise(0.0))
    return join_by(off, spread, by).withColumn("robust_z", F.when(F.col(value).isNotNull(), z)).drop(
        "_med", "_off", "_mad", "_aad")


def anomalies(scored: DataFrame, limit: float = 2.5) -> DataFrame:
    """Points whose robust z reaches the limit on either side."""
    return scored.where(F.abs("robust_z") >= limit)


def trend_source(series: DataFrame, by: Sequence[str] = ("measure_id",),
                 digits: int | None = None) -> DataFrame:
    """The series each trend test runs on: year over year when there is any, otherwise the
    monthly values when they are gapless and at least four, otherwise nothing."""
    by = list(by)
    kind = F.lit("monthly_yoy_pct")
    yoy = yoy_series(series, by, digits).withColumn("series", kind).withColumn("_rank", F.lit(1))
    regular = regular_months(series, by).where("regular").select(*by)
    plain = (series.join(regular, by).withColumn("series", F.lit("regular_monthly_value"))
             .withColumn("_rank", F.lit(2)))
    both = yoy.unionByName(plain)
    best = both.groupBy(*by).agg(F.min("_rank").alias("_rank"))
    return both.join(best, [*by, "_rank"]).select(*by, "series", "month", "value")


def trend_reading(tests: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Is the trend good for the measure, and how strongly may it be worded."""
    wanted = measure_attribute(measures, "direction")
    moving = F.col("direction").isin("increasing", "decreasing") & (wanted != "neutral")
    good = (F.col("direction") == "increasing") == (wanted == "higher_is_better")
    wording = (F.when(F.col("direction") == "insufficient_sample", "insufficient_sample")
               .when(F.col("n") < 8, "direction_only")
               .when(F.col("significant"), "trend_not_fluctuation")
               .otherwise("fluctuation"))
    return tests.withColumn("business_favorable", F.when(moving, good)).withColumn(
        "reading", wording)


def herfindahl(rows: DataFrame, medium: float | None = None, high: float | None = None,
               digits: int | None = None) -> DataFrame:
    """Concentration index per dimension from shares, with a level only under a declared policy."""
    if (medium is None) != (high is None):
        raise ValueError("both policy thresholds or none")
    if medium is not None and not 0 <= medium < high <= 1:
        raise ValueError("thresholds need 0 <= medium < high <= 1")
    share = F.col("share") if digits is None else F.bround("share", digits)
    found = (rows.groupBy("measure_id", "dimension")
             .agg(F.sum(F.pow(share / 100, F.lit(2))).alias("hhi"), F.min("share").alias("_low"))
             .withColumn("hhi", F.when(F.col("_low") >= 0, F.col("hhi"))).drop("_low"))
    status = F.when(F.col("hhi").isNull(), "SKIPPED").otherwise("APPLIED")
    found = found.withColumn("status", status)
    if medium is None:
        return found.withColumn("classification", F.lit("descriptive")).withColumn(
            "level", F.lit(None).cast("string"))
    return found.withColumn("classification", F.lit("policy")).withColumn(
        "level", F.when(F.col("hhi") >= high, "高集中").when(F.col("hhi") >= medium, "中度集中")
        .when(F.col("hhi").isNotNull(), "分散"))


def top5_level(row: DataFrame, medium: float, high: float) -> DataFrame:
    """Level of the top-five share under a declared policy (fixed wording)."""
    if not 0 <= medium < high <= 100:
        raise ValueError("thresholds need 0 <= medium < high <= 100")
    top = F.coalesce(F.col("top5_share"), F.lit(0.0))
    level = F.when(top >= high, "高").when(top >= medium, "中").otherwise("低")
    return row.withColumn("level", F.when(F.col("status") == "OK", level)).withColumn(
        "classification", F.when(F.col("status") == "OK", "policy").otherwise("unavailable"))


def dimension_scan(rows: DataFrame, measures: Sequence[Measure], unfavorable: float = 15.0,
                   favorable: float = 15.0, material: float = 2.0) -> DataFrame:
    """Members that moved far enough and matter enough, with ``verdict`` by direction."""
    wanted = measure_attribute(measures, "direction")
    additive = measure_attribute(measures, "additivity") == "additive"
    change = F.col("change_pct")
    matters = F.when(F.col("share").isNotNull(), F.col("share") >= material).otherwise(~additive)
    bad = F.when(wanted == "higher_is_better", change < 0).otherwise(change > 0)
    good = F.when(wanted == "higher_is_better", change > 0).otherwise(change < 0)
    verdict = (F.when(bad & (F.abs(change) >= abs(unfavorable)), "unfavorable")
               .when(good & (F.abs(change) >= abs(favorable)), "favorable"))
    return (rows.where(change.isNotNull() & matters & (wanted != "neutral"))
            .withColumn("verdict", verdict).where(F.col("verdict").isNotNull())
            .select("measure_id", "dimension", "name", "change_pct", "share", "delta",
                    "contribution_pp", "verdict"))


def contribution_rows(rows: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Members with a contribution, to be read from the most negative up."""
    additive = measure_attribute(measures, "additivity") == "additive"
    return rows.where(additive & F.col("contribution_pp").isNotNull()).select(
        "measure_id", "dimension", "name", "change_pct", "share", "delta", "contribution_pp")


def problem_list(scan: DataFrame, readings: DataFrame, measures: Sequence[Measure],
                 top5: DataFrame | None = None) -> DataFrame:
    """Adverse trend, adverse members and policy breach; the largest impact first when sorted by
    ``abs(impact)`` with unknown impact last."""
    primary = primary_of(measures).id
    trend = readings.where((F.col("measure_id") == primary) & F.col("significant")
                           & (F.col("business_favorable") == F.lit(False))).select(
        F.lit("adverse_trend").alias("type"), F.col("measure_id").alias("object"),
        F.lit(None).cast("double").alias("impact"))
    movers = scan.where((F.col("measure_id") == primary)
                        & (F.col("verdict") == "unfavorable")).select(
        F.lit("adverse_member").alias("type"),
        F.concat_ws("=", "dimension", "name").alias("object"), F.col("delta").alias("impact"))
    parts = [trend, movers]
    if top5 is not None:
        parts.append(top5.where(F.col("level") == "高").select(
            F.lit("concentration_policy").alias("type"), F.col("dimension").alias("object"),
            F.lit(None).cast("double").alias("impact")))
    return reduce(DataFrame.unionByName, parts)


def problem_order() -> list[Column]:
    return [F.abs("impact").desc_nulls_last(), F.col("type").asc(), F.col("object").asc()]


def method_applicability(rows: DataFrame, series: DataFrame | None, pvm: DataFrame | None,
                         measures: Sequence[Measure], snapshot: bool = False) -> DataFrame:
    """(method, measure_id, status, reason_code) from eligibility aggregates."""
    additive = measure_attribute(measures, "additivity") == "additive"
    dims = rows.groupBy("measure_id", "dimension").agg(
        F.count(F.lit(1)).alias("members"),
        (F.coalesce(F.min("current"), F.lit(0.0)) >= 0).alias("clean"))
    per = dims.groupBy("measure_id").agg((F.max("members") >= 2).alias("many"),
                                         F.every("clean").alias("clean"))
    per = per.withColumn("positive", additive & F.col("many") & F.col("clean"))

    def line(method: str, ok: Column, yes: str, no: str) -> Column:
        return F.struct(F.lit(method).alias("method"),
                        F.when(ok, "ELIGIBLE").otherwise("SKIPPED").alias("status"),
                        F.when(ok, yes).otherwise(no).alias("reason_code"))

    lines = per.select("measure_id", F.explode(F.array(
        line("topn", F.col("many"), "dimension_with_multiple_groups",
             "requires_dimension_with_multiple_groups"),
        line("pareto", F.col("positive"), "nonnegative_additive_measure",
             "requires_nonnegative_additive_measure"),
        line("hhi", F.col("positive"), "descriptive_only_without_policy",
             "requires_nonnegative_additive_measure"))).alias("l")).select(
        "l.method", "measure_id", "l.status", "l.reason_code")
    parts = [lines]
    primary = primary_of(measures).id
    spark = rows.sparkSession
    if snapshot or series is None:
        parts.append(spark.createDataFrame(
            [("mk_trend", primary, "SKIPPED", "snapshot_has_no_time_series")], lines.schema))
    else:
        # At most one row of the primary series is attached; without any the verdict stays.
        check = regular_months(series, ["measure_id"]).where(F.col("measure_id") == primary).select("regular")
        one = attach(spark.range(1).select(F.lit(primary).alias("measure_id")), check)
        ok = F.coalesce(F.col("regular"), F.lit(False))
        parts.append(one.select(
            F.lit("mk_trend").alias("method"), "measure_id",
            F.when(ok, "ELIGIBLE").otherwise("SKIPPED").alias("status"),
            F.when(ok, "regular_month_series_n_gte_4")
            .otherwise("requires_regular_time_series_n_gte_4").alias("reason_code")))
    if pvm is None:
        reason = "snapshot_has_no_time_baseline" if snapshot else (
            "requires_additive_amount_quantity")
        parts.append(spark.createDataFrame(
            [("pvm", primary, "SKIPPED", reason)], lines.schema))
    else:
        parts.append(pvm.select(
            F.lit("pvm").alias("method"), F.lit(primary).alias("measure_id"), "status",
            F.when(F.col("status") != "OK", "quality_gate_failed").alias("reason_code")))
    return reduce(DataFrame.unionByName, parts)
