"""E: measure aggregation by member, over time and over both axes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from measureloom.catalog.registry import (
    AVG_PRICE, CONTRACT, DIMS, DISCOUNT, EVENT_BASE, EVENT_CUR, LINES, MAX_PRICE, MEASURE_SQL,
    MEDIAN_PRICE, MIN_PRICE, PRICE_POINTS, QUANTITY, RETURNS, REVENUE, SALES, TIME, WEEK,
    facts_sql, level, lock_of, query, r4, sales, table,
)
from measureloom.operators import aggregate as a


def _by_segment_sql(*ids: str) -> str:
    values = ", ".join(f"{r4(MEASURE_SQL[m].format(f='true'))} AS {m}" for m in ids)
    return f"WITH {SALES} SELECT segment, {values} FROM sales GROUP BY segment"


def _by_segment(spark, d, *measures):
    return a.grouped(sales(spark, d), measures, ["segment"])


@query("e01_sum", _by_segment_sql("revenue", "quantity"))
def e01(spark, d):
    return _by_segment(spark, d, REVENUE, QUANTITY)


@query("e02_mean", _by_segment_sql("avg_price"))
def e02(spark, d):
    return _by_segment(spark, d, AVG_PRICE)


@query("e03_median", _by_segment_sql("median_price"))
def e03(spark, d):
    return _by_segment(spark, d, MEDIAN_PRICE)


@query("e03_median_total", f"WITH {SALES} SELECT "
       f"{r4(MEASURE_SQL['median_price'].format(f='true'))} AS median_price FROM sales")
def e03_total(spark, d):
    return a.grouped(sales(spark, d), [MEDIAN_PRICE], [])


@query("e04_min_max", _by_segment_sql("min_price", "max_price"))
def e04(spark, d):
    return _by_segment(spark, d, MIN_PRICE, MAX_PRICE)


@query("e05_count", _by_segment_sql("lines"))
def e05(spark, d):
    return _by_segment(spark, d, LINES)


@query("e06_distinct_count", _by_segment_sql("price_points"))
def e06(spark, d):
    return _by_segment(spark, d, PRICE_POINTS)


@query("e07_weighted_mean", _by_segment_sql("discount_pct"))
def e07(spark, d):
    return _by_segment(spark, d, DISCOUNT)


@query("e08_ratio", _by_segment_sql("return_pct"))
def e08(spark, d):
    return _by_segment(spark, d, RETURNS)


# --- two axes ----------------------------------------------------------------------------------

_INNER = {"sum": "sum(value)", "mean": "avg(value)", "median": "median(value)",
          "max": "max(value)"}
_OUTER = {"sum": "sum(v)", "mean": "avg(v)", "median": "median(v)", "min": "min(v)",
          "max": "max(v)", "ending": "arg_max(v, day)", "last_non_null": "arg_max(v, day)"}


def _level_sql(inner: str, outer: str) -> str:
    def side(condition: str, keys: str, dimension: str, name: str) -> str:
        return (f"SELECT {dimension} AS dimension, {name} AS name, {_OUTER[outer]} AS v FROM ("
                f"SELECT {keys} ts::DATE AS day, {_INNER[inner]} AS v FROM events "
                f"WHERE {condition} GROUP BY ALL) GROUP BY ALL")

    def both(condition: str) -> str:
        return (side(condition, "event_type,", "'event_type'", "event_type") + " UNION ALL "
                + side(condition, "", "'(total)'", "'(total)'"))

    return f"""WITH c AS ({both(EVENT_CUR)}), b AS ({both(EVENT_BASE)})
SELECT dimension, name, {r4('c.v')} AS current, {r4('b.v')} AS baseline
FROM c FULL JOIN b USING (dimension, name)"""


def _level(spark, d, inner, outer):
    events = table(spark, d, "events")
    facts = a.member_facts(events, [level(inner, outer)], ["event_type"],
                           lock_of(events, WEEK, "ts"), "ts")
    return facts.select("dimension", "name", "current", "baseline")


for _inner, _outer in (("sum", "ending"), ("sum", "last_non_null"), ("sum", "mean"),
                       ("mean", "median"), ("sum", "min"), ("max", "max"), ("median", "sum")):
    query(f"e09_{_inner}_by_day_{_outer}", _level_sql(_inner, _outer))(
        lambda spark, d, i=_inner, o=_outer: _level(spark, d, i, o))


# --- members, all measures, series -------------------------------------------------------------

@query("e10_group_with_null_member", f"""WITH {SALES}, n AS (SELECT *,
  CASE WHEN region <> 'ASIA' THEN region END AS area FROM sales)
SELECT coalesce(area, '(空值)') AS area, {r4('sum(revenue)')} AS revenue,
  {r4('100 * sum(returned) / sum(quantity)')} AS return_pct FROM n GROUP BY ALL""")
def e10(spark, d):
    df = sales(spark, d).withColumn("area", F.when(F.col("region") != "ASIA", F.col("region")))
    return a.grouped(df, [REVENUE, RETURNS], ["area"])


_FACTS = f"""SELECT measure_id, dimension, name, {r4('current')} AS current,
  {r4('baseline')} AS baseline, in_current, in_base FROM facts"""


@query("e11_all_measures_all_dimensions",
       f"WITH {SALES}, {facts_sql([m.id for m in CONTRACT], DIMS)} {_FACTS}")
def e11(spark, d):
    df = sales(spark, d)
    return a.member_facts(df, CONTRACT, DIMS, lock_of(df), TIME)


_MIXED = (REVENUE, AVG_PRICE, MEDIAN_PRICE, MIN_PRICE, MAX_PRICE, LINES, PRICE_POINTS)


@query("e11_every_aggregation",
       f"WITH {SALES}, {facts_sql([m.id for m in _MIXED], ('region', 'segment'))} {_FACTS}")
def e11_every(spark, d):
    df = sales(spark, d)
    return a.member_facts(df, _MIXED, ("region", "segment"), lock_of(df), TIME)


@query("e12_distribution", f"""WITH {SALES}, v AS (
  SELECT region, 'revenue' AS measure_id, revenue AS v FROM sales
  WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'
  UNION ALL SELECT region, 'quantity', quantity FROM sales
  WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30')
SELECT region, measure_id, count(v) AS count, {r4('min(v)')} AS min,
  {r4('quantile_cont(v, 0.25)')} AS p25, {r4('quantile_cont(v, 0.5)')} AS median,
  {r4('quantile_cont(v, 0.75)')} AS p75, {r4('max(v)')} AS max, {r4('avg(v)')} AS mean
FROM v GROUP BY region, measure_id""")
def e12(spark, d):
    df = sales(spark, d)
    return a.distribution(df, [REVENUE, QUANTITY], lock_of(df), TIME, by=["region"])


def _series_sql(keys: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS measure_id, {keys} date_trunc('month', o_orderdate)::DATE AS month, "
        f"{MEASURE_SQL[m].format(f='true')} AS value FROM sales GROUP BY ALL"
        for m in ("revenue", "quantity", "discount_pct", "return_pct"))


@query("e13_monthly_series", f"""WITH {SALES}, s AS ({_series_sql('segment,')})
SELECT measure_id, segment, month, {r4('value')} AS value FROM s WHERE value IS NOT NULL""")
def e13(spark, d):
    return a.monthly_series(sales(spark, d), CONTRACT, TIME, by=["segment"])


@query("e13_monthly_ending", f"""SELECT 'level' AS measure_id, date_trunc('month', day)::DATE AS month,
  {r4('arg_max(v, day)')} AS value FROM (SELECT ts::DATE AS day, sum(value) AS v FROM events
  GROUP BY ALL) GROUP BY ALL""")
def e13_ending(spark, d):
    return a.monthly_series(table(spark, d, "events"), [level()], "ts")


@query("e13_weekly_series", f"""SELECT strftime(ts, '%G-W%V') AS period, {r4('avg(value)')} AS value
FROM events GROUP BY ALL""")
def e13_weekly(spark, d):
    mean = replace(level(), aggregation="mean", time_aggregation=None, additivity="non_additive")
    return a.period_series(table(spark, d, "events"), mean, "ts", "week")


_MATRIX = f"""matrix AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month,
  sum(revenue) / 10000 AS value FROM sales
  WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'
     OR o_orderdate BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' GROUP BY ALL)"""


@query("e14_year_month_matrix", f"""WITH {SALES}, {_MATRIX}
SELECT year, month, {r4('value')} AS value FROM matrix""")
def e14(spark, d):
    df = sales(spark, d)
    return a.year_month_matrix(df, REVENUE, lock_of(df), TIME, scale=1e4)


@query("e14_year_month_wide", f"WITH {SALES}, {_MATRIX} SELECT year, " + ", ".join(
    f"{r4(f'max(value) FILTER (WHERE month = {m})')} AS m{m:02d}" for m in range(1, 13))
    + " FROM matrix GROUP BY year")
def e14_wide(spark, d):
    df = sales(spark, d)
    return a.year_month_wide(a.year_month_matrix(df, REVENUE, lock_of(df), TIME, scale=1e4))


@query("e15_window_trend", f"""WITH {SALES}, m AS (SELECT unnest(generate_series(
  DATE '2000-06-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS month)
SELECT m.month, {r4('sum(revenue)')} AS value, count(o_orderdate) = 0 AS missing
FROM m LEFT JOIN sales ON date_trunc('month', o_orderdate) = m.month GROUP BY m.month""")
def e15(spark, d):
    return a.window_trend(sales(spark, d), REVENUE, TIME, "2000-06-15", "2001-12-31")


@query("e11_reserved_names", f"""WITH {SALES}, {facts_sql(['revenue', 'median_price', 'price_points'],
  ['region', 'segment', 'flag'])}
SELECT measure_id, CASE dimension WHEN 'region' THEN 'name' WHEN 'segment' THEN 'dimension'
  WHEN 'flag' THEN 'in_current' ELSE dimension END AS dimension, name, {r4('current')} AS current,
  {r4('baseline')} AS baseline, in_current, in_base FROM facts""")
def e11_reserved_names(spark, d):
    """Dimensions named like result columns."""
    df = sales(spark, d).withColumnsRenamed({"region": "name", "segment": "dimension", "flag": "in_current"})
    return a.member_facts(df, (REVENUE, MEDIAN_PRICE, PRICE_POINTS), ("name", "dimension", "in_current"),
                          lock_of(df), TIME)


@query("e13_reserved_names", f"""WITH {SALES} SELECT 'revenue' AS measure_id, segment AS member_value,
  CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS month, {r4('sum(revenue)')} AS value
FROM sales GROUP BY ALL""")
def e13_reserved_names(spark, d):
    df = sales(spark, d).withColumnRenamed("segment", "value")
    return a.monthly_series(df, [REVENUE], TIME, by=["value"])
