"""Statistics on top of a report: trend, anomalies, movers, concentration, problems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measureloom.contract import primary_of
from measureloom.operators import compare, shape
from measureloom.operators import statistics as stats
from measureloom.plans.report import Report
from measureloom.session import cut_lineage


@dataclass(frozen=True)
class Insights:
    scan: DataFrame
    contributions: DataFrame
    share_shifts: DataFrame
    hhi: DataFrame
    problems: DataFrame
    trend: DataFrame | None = None
    anomalies: DataFrame | None = None
    trailing: DataFrame | None = None
    quadrant: DataFrame | None = None
    concentration: DataFrame | None = None


def derive_insights(report: Report, unfavorable: float = 15.0, favorable: float = 15.0,
                    material: float = 2.0, shift_pp: float = 1.5, z_limit: float = 2.5,
                    hhi_policy: tuple[float, float] | None = None,
                    top5_policy: tuple[float, float] | None = None) -> Insights:
    """Read a report that is not BLOCKED; its one-row status is checked first."""
    status = report.status.head()["status"]
    if status == "BLOCKED":
        raise ValueError("the report is BLOCKED; fix the data first")
    measures, roles = report.measures, report.contract.roles
    primary = primary_of(measures)
    rows = cut_lineage(report.rows.where(
        (F.col("measure_id") == primary.id) & F.col("dimension").isin(*roles.dimensions, "")))
    scan = stats.dimension_scan(rows, measures, unfavorable, favorable, material)
    medium, high = hhi_policy or (None, None)
    trend = readings = anomalies = trailing = None
    if report.series is not None:
        series = cut_lineage(report.series.where(F.col("measure_id") == primary.id))
        source = stats.trend_source(series)
        tests = stats.mann_kendall(source, ["measure_id"])
        readings = trend = stats.trend_reading(tests, measures)
        anomalies = stats.anomalies(stats.robust_z(source, ["measure_id"]), z_limit)
        trailing = shape.trailing_negative_run(compare.yoy_series(series), ["measure_id"])
    top5 = report.concentration
    if top5 is not None and top5_policy is not None:
        top5 = stats.top5_level(top5, *top5_policy)
    if readings is None:
        readings = rows.sparkSession.createDataFrame(
            [], "measure_id string, significant boolean, business_favorable boolean")
    problems = stats.problem_list(scan, readings, measures, top5 if top5_policy else None)
    quadrant = compare.pvm_quadrant(report.pvm) if report.pvm is not None else None
    return Insights(
        scan, stats.contribution_rows(rows, measures), compare.share_shift(rows, shift_pp),
        stats.herfindahl(rows, medium, high), problems, trend, anomalies, trailing, quadrant, top5)
