"""Lock the reporting period and its baseline, and tag rows with the side they belong to."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.contract import COMPARISONS, Scope
from measureloom.functions import calendar as cal
from measureloom.functions import cleaning, dates
from measureloom.operators.onerow import attach

CURRENT, BASE = "in_current", "in_base"


@dataclass(frozen=True)
class Lock:
    """The locked dates as literals, so that date filters reach the scan."""

    label: str
    granularity: str
    start: dt.date
    end: dt.date
    requested_end: dt.date
    base_start: dt.date | None
    base_end: dt.date | None
    comparison_type: str
    mode: str = "period"

    @property
    def has_base(self) -> bool:
        return self.base_start is not None and self.base_end is not None


def _date(text: str | None) -> Column:
    """Strict yyyy-MM-dd literal; anything else is null and shows up as a missing cutoff."""
    c = F.lit(text).cast("string")
    return F.to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"),
                            F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))


def lock_frame(spark: SparkSession, scope: Scope, last_day: DataFrame | None = None) -> DataFrame:
    """One row with every date of the locked scope.

    ``last_day`` is a one-row DataFrame with column ``last_day``; it is only read when the period
    label was left open and has to be inferred.
    """
    one = spark.range(1).drop("id")
    label = F.lit(scope.period).cast("string")
    named = cal.period_bounds(label)
    one = one.withColumn("inferred", cal.is_placeholder(label))
    if last_day is not None:
        one = attach(one, last_day.select("last_day"))
        one = one.withColumn("p", F.when(
            F.col("inferred"), cal.inferred_bounds(F.col("last_day"), scope.granularity)
        ).otherwise(named))
    else:
        one = one.withColumn("p", named)
    one = one.select(
        F.col("p.label").alias("label"),
        F.when(F.col("p.granularity") == "custom", F.lit(scope.granularity))
        .otherwise(F.col("p.granularity")).alias("window_granularity"),
        F.col("p.granularity").alias("granularity"),
        F.col("p.start").alias("start"), F.col("p.end").alias("requested_end"), "inferred")
    custom = (cal.period_bounds(F.lit(scope.baseline_period))
              if scope.baseline_period is not None else None)
    one = one.withColumn("b", cal.baseline_window(
        scope.comparison, F.col("start"), F.col("requested_end"), F.col("granularity"), custom))
    kind = scope.comparison_type
    as_of, base_as_of = _date(scope.data_as_of), _date(scope.comparison_as_of)
    end = F.least(F.col("requested_end"), as_of)
    base_end = F.col("b.end")
    elapsed = F.datediff(F.col("end"), F.col("start"))
    if kind == "year_over_year":
        base_end = F.when(F.col("end") < F.col("requested_end"),
                          F.least(base_end, F.add_months(F.col("end"), -12))).otherwise(base_end)
    elif kind == "same_stage_previous_period":
        base_end = F.least(base_end, F.date_add(F.col("b.start"), elapsed))
    one = one.withColumn("end", end)
    covered = elapsed + 1
    requested = F.datediff(F.col("requested_end"), F.col("start")) + 1
    has_base = F.col("b.start").isNotNull()
    return one.select(
        "label", "granularity", "start", "end", "requested_end",
        F.col("b.start").alias("base_start"),
        F.when(has_base, base_end).alias("base_end"),
        F.col("b.end").alias("requested_base_end"),
        as_of.alias("data_as_of"), base_as_of.alias("comparison_as_of"),
        F.when(F.col("end") >= F.col("requested_end"), "complete")
        .otherwise("partial_same_cutoff").alias("completeness"),
        (covered / requested * 100).alias("calendar_coverage_pct"),
        F.lit(kind).alias("comparison_type"),
        (~has_base | F.coalesce(base_as_of >= base_end, F.lit(False))).alias("like_for_like"),
        "inferred",
    )


def last_day(df: DataFrame, time: str, timezone: str | None = None) -> DataFrame:
    """Latest business day of a table, as one row."""
    return df.agg(F.to_date(F.max(cleaning.timestamp(df, time, timezone))).alias("last_day"))


def lock_row(df: DataFrame, scope: Scope, time: str) -> DataFrame:
    """The lock of a scope on a table; its last day is only looked up for an open period."""
    known = last_day(df, time, scope.timezone) if _open_period(scope) else None
    return lock_frame(df.sparkSession, scope, known)


def _open_period(scope: Scope) -> bool:
    return re.search(cal.PLACEHOLDER, (scope.period or "").strip()) is not None


def declared_lock(scope: Scope) -> Lock:
    """The lock of a declared period, from its label and cutoffs alone: no job runs."""
    found = dates.period(scope.period)
    if found is None:
        raise ValueError(f"period {scope.period!r} cannot be resolved")
    start, requested_end, granularity, label = found
    if COMPARISONS[scope.comparison] == "custom" and scope.baseline_period is None:
        raise ValueError("a custom comparison needs a baseline period")
    custom = dates.period(scope.baseline_period) if scope.baseline_period is not None else None
    base = dates.baseline(scope.comparison, start, requested_end, granularity, custom)
    as_of = dates.strict_day(scope.data_as_of)
    end = min(requested_end, as_of) if as_of else requested_end
    base_start, base_end = base or (None, None)
    if base and scope.comparison_type == "year_over_year" and end < requested_end:
        base_end = min(base_end, dates.add_months(end, -12))
    elif base and scope.comparison_type == "same_stage_previous_period":
        base_end = min(base_end, base_start + (end - start))
    return Lock(label, granularity, start, end, requested_end, base_start, base_end,
                scope.comparison_type)


def resolve(df: DataFrame, scope: Scope, time: str | None) -> Lock:
    """The lock as literals. A job runs only to infer an open period, and collects one row."""
    if scope.mode == "snapshot" or time is None:
        far = dt.date(9999, 12, 31)
        return Lock("snapshot", "snapshot", dt.date(1, 1, 1), far, far, None, None, "none",
                    "snapshot")
    if not _open_period(scope):
        return declared_lock(scope)
    row = lock_row(df, scope, time).head()
    if row["start"] is None:
        raise ValueError(f"period {scope.period!r} cannot be resolved")
    end = row["end"] or row["requested_end"]
    return Lock(row["label"], row["granularity"], row["start"], end, row["requested_end"],
                row["base_start"], row["base_end"], row["comparison_type"])


def within(df: DataFrame, time: str, start: dt.date, end: dt.date,
           timezone: str | None = None) -> Column:
    """Closed interval of whole business days.

    On a stored date or timestamp the test is a plain range on the raw column, so it is pushed to
    the scan and prunes partitions.
    """
    kind = df.schema[time].dataType
    c = F.col(f"`{time}`")
    if isinstance(kind, T.DateType):
        return c.between(F.lit(start), F.lit(end))
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.to_date(cleaning.timestamp(df, time, timezone))
        return c.between(F.lit(start), F.lit(end))
    after = end + dt.timedelta(days=1)
    if isinstance(kind, T.TimestampType) and timezone:
        # The midnights of the business zone as instants: still a plain range for the scan.
        low, high = (F.lit(dt.datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(timezone)))
                     for d in (start, after))
        return (c >= low) & (c < high)
    return (c >= F.lit(start).cast(kind)) & (c < F.lit(after).cast(kind))


def side_flags(df: DataFrame, lock: Lock, time: str | None,
               timezone: str | None = None) -> tuple[Column, Column]:
    """Current and baseline membership; a row may be in both when windows overlap."""
    if lock.mode == "snapshot" or time is None:
        return F.lit(True), F.lit(False)
    current = F.coalesce(within(df, time, lock.start, lock.end, timezone), F.lit(False))
    if not lock.has_base:
        return current, F.lit(False)
    base = F.coalesce(within(df, time, lock.base_start, lock.base_end, timezone), F.lit(False))
    return current, base


def tag(df: DataFrame, lock: Lock, time: str | None, timezone: str | None = None,
        only_scope: bool = True) -> DataFrame:
    """Add ``in_current`` and ``in_base``; by default keep only rows in one of them."""
    current, base = side_flags(df, lock, time, timezone)
    if only_scope:
        df = in_scope(df, lock, time, timezone)
    return df.withColumn(CURRENT, current).withColumn(BASE, base)


def in_scope(df: DataFrame, lock: Lock, time: str | None, timezone: str | None = None) -> DataFrame:
    """Rows of the current period or the baseline."""
    if lock.mode == "snapshot" or time is None:
        return df
    wanted = within(df, time, lock.start, lock.end, timezone)
    if lock.has_base:
        wanted = wanted | within(df, time, lock.base_start, lock.base_end, timezone)
    return df.where(wanted)


def roles(df: DataFrame) -> DataFrame:
    """One row per (row, side): column ``period_role``; rows in both windows appear twice."""
    sides = F.array(F.when(F.col(CURRENT), F.lit("current")), F.when(F.col(BASE), F.lit("base")))
    return df.withColumn("period_role", F.explode(F.filter(sides, lambda s: s.isNotNull())))
