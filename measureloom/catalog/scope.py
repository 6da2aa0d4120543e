"""D: period filters, comparison windows, locks and row tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from measureloom.catalog.registry import H1, SALES, TIME, lock_of, query, r4, sales, table
from measureloom.contract import Scope
from measureloom.functions import calendar as cal
from measureloom.operators import scope as s


@query("d01_period_filter", f"""WITH {SALES} SELECT region, count(*) AS lines,
  {r4('sum(revenue)')} AS revenue FROM sales
WHERE o_orderdate >= DATE '2000-01-01' AND o_orderdate < DATE '2000-07-01' GROUP BY region""")
def period_filter(spark, d):
    df = sales(spark, d)
    lock = lock_of(df)
    return df.where(s.within(df, TIME, lock.start, lock.end)).groupBy("region").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue"))


_GRAINS = ("week", "month", "quarter", "half", "year")
_START = {
    "week": "date_trunc('week', o_orderdate)::DATE", "month": "date_trunc('month', o_orderdate)::DATE",
    "quarter": "date_trunc('quarter', o_orderdate)::DATE",
    "half": "make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1)",
    "year": "make_date(year(o_orderdate), 1, 1)",
}
_LENGTH = {"week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "half": "6 MONTH",
           "year": "1 YEAR"}
_PERIODS = "periods AS (" + " UNION ".join(
    f"SELECT '{g}' AS granularity, {_START[g]} AS \"start\", "
    f"({_START[g]} + INTERVAL {_LENGTH[g]} - INTERVAL 1 DAY)::DATE AS \"end\" FROM orders"
    for g in _GRAINS) + ")"


def _periods(spark, d):
    """Every calendar period that holds an order, with its bounds."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    labels = F.array(*[cal.period_key(F.col("d"), g) for g in _GRAINS])
    texts = days.select(F.explode(labels).alias("text")).distinct()
    return texts.select(cal.period_bounds(F.col("text")).alias("p")).select("p.*")


def _windows(spark, d, comparison, custom=None):
    p = _periods(spark, d)
    found = cal.baseline_window(comparison, F.col("start"), F.col("end"), F.col("granularity"),
                                custom)
    return p.withColumn("b", found).select(
        "granularity", "start", "end", F.col("b.start").alias("base_start"),
        F.col("b.end").alias("base_end"))


@query("d02_year_over_year_window", f"""WITH {_PERIODS} SELECT granularity, "start", "end",
  ("start" - INTERVAL 1 YEAR)::DATE AS base_start, ("end" - INTERVAL 1 YEAR)::DATE AS base_end
FROM periods""")
def yoy_window(spark, d):
    return _windows(spark, d, "yoy")


@query("d03_previous_equal_window", f"""WITH {_PERIODS} SELECT granularity, "start", "end",
  "start" - ("end" - "start" + 1)::INTEGER AS base_start, "start" - 1 AS base_end FROM periods""")
def equal_window(spark, d):
    return _windows(spark, d, "previous_equal_window")


_PREVIOUS = ("SELECT granularity, \"start\", \"end\", CASE granularity " + " ".join(
    f"WHEN '{g}' THEN (\"start\" - INTERVAL {_LENGTH[g]})::DATE" for g in _GRAINS)
    + " END AS base_start, \"start\" - 1 AS base_end FROM periods")


@query("d04_previous_calendar_period", f"WITH {_PERIODS} {_PREVIOUS}")
def calendar_window(spark, d):
    return _windows(spark, d, "previous_calendar_period")


@query("d04_granularity_alias", f"""WITH {_PERIODS} SELECT granularity, "start", "end",
  CASE WHEN granularity = 'month' THEN ("start" - INTERVAL 1 MONTH)::DATE END AS base_start,
  CASE WHEN granularity = 'month' THEN "start" - 1 END AS base_end FROM periods""")
def alias_window(spark, d):
    return _windows(spark, d, "mom")


def _two_sides(df, scope, keys=("region",)):
    lock = lock_of(df, scope)
    tagged = s.tag(df.select(TIME, *keys, "revenue"), lock, TIME)
    return tagged.groupBy(*keys).agg(
        F.sum(F.when(F.col("in_current"), F.col("revenue"))).alias("current"),
        F.sum(F.when(F.col("in_base"), F.col("revenue"))).alias("baseline"))


def _two_sides_sql(cur: str, base: str) -> str:
    return f"""WITH {SALES} SELECT region,
  {r4(f'sum(revenue) FILTER (WHERE {cur})')} AS current,
  {r4(f'sum(revenue) FILTER (WHERE {base})')} AS baseline
FROM sales WHERE ({cur}) OR ({base}) GROUP BY region"""


@query("d05_same_stage", _two_sides_sql(
    "o_orderdate BETWEEN DATE '2000-07-01' AND DATE '2000-08-20'",
    "o_orderdate BETWEEN DATE '2000-04-01' AND DATE '2000-05-21'"))
def same_stage(spark, d):
    return _two_sides(sales(spark, d), Scope(
        period="2000Q3", comparison="same_stage", data_as_of="2000-08-20",
        comparison_as_of="2000-05-21"))


@query("d06_custom_baseline", _two_sides_sql(
    "o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'",
    "o_orderdate BETWEEN DATE '1997-03-05' AND DATE '1997-09-12'"))
def custom_baseline(spark, d):
    return _two_sides(sales(spark, d), Scope(
        period="2000H1", comparison="custom", baseline_period="1997-03-05..1997-09-12",
        data_as_of="2000-06-30", comparison_as_of="1997-09-12"))


@query("d07_partial_period", _two_sides_sql(
    "o_orderdate BETWEEN DATE '2001-07-01' AND DATE '2001-07-15'",
    "o_orderdate BETWEEN DATE '2000-07-01' AND DATE '2000-07-15'"))
def partial_period(spark, d):
    return _two_sides(sales(spark, d), Scope(
        period="2001Q3", comparison="yoy", data_as_of="2001-07-15",
        comparison_as_of="2000-07-15"))


@query("d08_snapshot", f"""WITH {SALES} SELECT region, {r4('sum(revenue)')} AS current,
  NULL::DOUBLE AS baseline FROM sales GROUP BY region""")
def snapshot(spark, d):
    return _two_sides(sales(spark, d), Scope(mode="snapshot"))


@query("d09_inferred_period", """SELECT year(m) || 'YTD' AS label, make_date(year(m), 1, 1) AS "start",
  last_day(m) AS requested_end, true AS inferred
FROM (SELECT max(o_orderdate)::DATE AS m FROM orders)""")
def inferred_period(spark, d):
    orders = table(spark, d, "orders")
    scope = Scope(period=None, data_as_of="2001-12-31", allow_inferred_period=True)
    return s.lock_frame(spark, scope, s.last_day(orders, TIME)).select(
        "label", "start", "requested_end", "inferred")


@query("d10_period_lock", f"""WITH last AS (SELECT max(o_orderdate)::DATE AS m FROM orders)
SELECT make_date(year(m), 1, 1) AS "start", last_day(m) AS "end", last_day(m) AS requested_end,
  make_date(year(m) - 1, 1, 1) AS base_start,
  (last_day(m) - INTERVAL 1 YEAR)::DATE AS base_end,
  CASE WHEN last_day(m) <= DATE '2001-12-31' THEN 'complete' END AS completeness,
  {r4('100.0')} AS calendar_coverage_pct, 'year_over_year' AS comparison_type,
  (last_day(m) - INTERVAL 1 YEAR)::DATE <= DATE '2000-12-31' AS like_for_like,
  'month' AS granularity
FROM last""")
def period_lock(spark, d):
    scope = Scope(period="auto", comparison="yoy", data_as_of="2001-12-31",
                  comparison_as_of="2000-12-31")
    return s.lock_frame(spark, scope, s.last_day(table(spark, d, "orders"), TIME)).select(
        "start", "end", "requested_end", "base_start", "base_end", "completeness",
        "calendar_coverage_pct", "comparison_type", "like_for_like", "granularity")


@query("d11_row_roles_overlap", """SELECT period_role, o_orderstatus, count(*) AS orders FROM (
  SELECT 'current' AS period_role, o_orderstatus FROM orders
  WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'
  UNION ALL SELECT 'base', o_orderstatus FROM orders
  WHERE o_orderdate BETWEEN DATE '1999-10-01' AND DATE '2000-03-31') GROUP BY ALL""")
def row_roles(spark, d):
    orders = table(spark, d, "orders").select(TIME, "o_orderstatus")
    scope = Scope(period="2000H1", comparison="custom", baseline_period="1999-10-01..2000-03-31",
                  data_as_of="2000-06-30", comparison_as_of="2000-03-31")
    tagged = s.roles(s.tag(orders, lock_of(orders, scope), TIME))
    return tagged.groupBy("period_role", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("d11_quality_scope", """SELECT count(*) FILTER (WHERE cur OR base) AS scope_rows,
  count(*) FILTER (WHERE cur) AS current_rows, count(*) FILTER (WHERE base) AS base_rows
FROM (SELECT o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' AS cur,
  o_orderdate BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' AS base FROM orders)""")
def quality_scope(spark, d):
    orders = table(spark, d, "orders").select(TIME)
    tagged = s.tag(orders, lock_of(orders, H1), TIME)
    return tagged.agg(F.count(F.lit(1)).alias("scope_rows"),
                      F.count_if("in_current").alias("current_rows"),
                      F.count_if("in_base").alias("base_rows"))
