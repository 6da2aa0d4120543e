"""H: trend tests, anomalies, concentration indices, scans and the problem list."""

from __future__ import annotations

from pyspark.sql import functions as F

from measureloom.catalog.comparisons import MONTHLY, ROWS, YOY, bridge, monthly, rows
from measureloom.catalog.registry import (
    CONTRACT, DIMS, DIRECTION, RETURNS, REVENUE, SALES, TIME, lock_of, query, r4, sales,
)
from measureloom.catalog.shapes import CUSTOMER_SUMS, customer_facts
from measureloom.contract import TOTAL, Thresholds
from measureloom.functions.special import two_sided_p
from measureloom.operators import aggregate as a
from measureloom.operators import compare as c
from measureloom.operators import shape as g
from measureloom.operators import statistics as s
from measureloom.operators.ordering import ranked

BY = ["measure_id", "segment"]


def mk_sql(source: str, keys: str = "segment", name: str = "mk") -> str:
    """CTE with n, s, var and z of every series of ``source`` (keys, month, value)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(",")) if keys else "true"
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(",")) + "," if keys else ""
    k = keys + "," if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""{name}_s AS (SELECT {a_keys} sum(sign(b.value - a.value))::BIGINT AS s
  FROM {source} a JOIN {source} b ON {on} AND a.month < b.month GROUP BY ALL),
{name}_t AS (SELECT {k} sum(t)::BIGINT AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (
  SELECT {k} value, count(*) AS t FROM {source} GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT {k} n, s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var
  FROM {name}_t LEFT JOIN {name}_s {using})"""


_Z = "CASE WHEN s > 0 THEN (s - 1) / sqrt(var) WHEN s < 0 THEN (s + 1) / sqrt(var) ELSE 0 END"
_TESTED = "(n >= 4 AND var > 0)"
_DIRECTION = f"""CASE WHEN NOT {_TESTED} THEN 'insufficient_sample' WHEN s > 0 THEN 'increasing'
  WHEN s < 0 THEN 'decreasing' ELSE 'no_trend' END"""
_SIGNIFICANT = f"coalesce({_TESTED} AND n >= 8 AND abs({_Z}) > 1.959963984540054, false)"


def _mk_columns(keys: str) -> str:
    return f"""{keys} n, CASE WHEN {_TESTED} THEN s END AS s,
  {r4(f'CASE WHEN {_TESTED} THEN var END')} AS var_s,
  {r4(f'CASE WHEN {_TESTED} THEN {_Z} END')} AS z, {_DIRECTION} AS direction,
  {_SIGNIFICANT} AS significant"""


@query("h01_mann_kendall_yoy", f"""WITH {SALES}, {MONTHLY}, {YOY}, {mk_sql('yoy')}
SELECT {_mk_columns('segment,')} FROM mk""")
def h01(spark, d):
    return s.mann_kendall(c.yoy_series(monthly(spark, d), BY), ["segment"]).drop("p")


@query("h01_mann_kendall_brand_returns", f"""WITH {SALES}, r AS (SELECT brand,
  date_trunc('month', o_orderdate)::DATE AS month,
  floor(100 * sum(returned) / sum(quantity) + 1e-9) / 100 AS value FROM sales GROUP BY ALL),
{mk_sql('r', 'brand')} SELECT {_mk_columns('brand,')} FROM mk""")
def h01_ties(spark, d):
    series = a.monthly_series(sales(spark, d), [RETURNS], TIME, by=["brand"])
    tied = series.withColumn("value", F.floor(F.col("value") + 1e-9) / 100)
    return s.mann_kendall(tied, ["brand"]).drop("p")


# Two-sided p by the midpoint rule over the normal density, 4,000 steps up to |z|.
_P = """1 - 2 * (SELECT sum(exp(-pow((i + 0.5) * abs(z) / 4000, 2) / 2)) * abs(z) / 4000 / sqrt(2 * pi())
  FROM range(4000) steps(i))"""


@query("h02_p_value", f"""WITH {SALES}, {MONTHLY}, {YOY}, {mk_sql('yoy')},
t AS (SELECT segment, CASE WHEN {_TESTED} THEN {_Z} END AS z FROM mk)
SELECT segment, {r4('z')} AS z, {r4(_P)} AS p FROM t""")
def h02(spark, d):
    tests = s.mann_kendall(c.yoy_series(monthly(spark, d), BY), ["segment"])
    return tests.select("segment", "z", two_sided_p(F.col("z")).alias("p"))


_ROBUST = """med AS (SELECT segment, median(value) AS med FROM yoy GROUP BY segment),
spread AS (SELECT segment, any_value(med) AS med, median(abs(value - med)) AS mad,
    avg(abs(value - med)) AS aad FROM yoy JOIN med USING (segment) GROUP BY segment),
scored AS (SELECT segment, month, value, CASE WHEN mad <> 0 THEN 0.6745 * (value - med) / mad
    WHEN aad <> 0 THEN (value - med) / (1.2533 * aad) ELSE 0 END AS robust_z
  FROM yoy JOIN spread USING (segment))"""


def _scored(spark, d):
    return s.robust_z(c.yoy_series(monthly(spark, d), BY), BY)


@query("h03_robust_z", f"""WITH {SALES}, {MONTHLY}, {YOY}, {_ROBUST}
SELECT segment, month, {r4('value')} AS value, {r4('robust_z')} AS robust_z FROM scored""")
def h03(spark, d):
    return _scored(spark, d).select("segment", "month", "value", "robust_z")


@query("h04_anomalies", f"""WITH {SALES}, {MONTHLY}, {YOY}, {_ROBUST}
SELECT segment, month, {r4('value')} AS value, {r4('robust_z')} AS robust_z FROM scored
WHERE abs(robust_z) >= 2.5""")
def h04(spark, d):
    return s.anomalies(_scored(spark, d)).select("segment", "month", "value", "robust_z")


# BUILDING keeps one year of history (no year over year), FURNITURE a gap in it as well.
_MIXED = """mixed AS (SELECT * FROM monthly WHERE segment NOT IN ('BUILDING', 'FURNITURE')
    OR (year(month) = 1996 AND NOT (segment = 'FURNITURE' AND month(month) = 5))),
yoy AS (SELECT a.measure_id, a.segment, a.month, (a.value / b.value - 1) * 100 AS value
  FROM mixed a JOIN mixed b ON a.segment = b.segment
    AND b.month = (a.month - INTERVAL 1 YEAR)::DATE WHERE b.value > 0 AND a.value >= 0),
src AS (SELECT segment, 'monthly_yoy_pct' AS series, month, value FROM yoy
  UNION ALL SELECT segment, 'regular_monthly_value', month, value FROM mixed
  WHERE segment = 'BUILDING')"""


def _mixed(spark, d):
    kept = ~F.col("segment").isin("BUILDING", "FURNITURE") | (
        (F.year("month") == 1996) & ~((F.col("segment") == "FURNITURE") & (F.month("month") == 5)))
    return s.trend_source(monthly(spark, d).where(kept), BY)


@query("h05_trend_source", f"""WITH {SALES}, {MONTHLY}, {_MIXED}
SELECT segment, series, month, {r4('value')} AS value FROM src""")
def h05(spark, d):
    return _mixed(spark, d).select("segment", "series", "month", "value")


@query("h06_trend_reading", f"""WITH {SALES}, {MONTHLY}, {_MIXED}, {mk_sql('src')}
SELECT segment, n, {_DIRECTION} AS direction, {_SIGNIFICANT} AS significant,
  CASE {_DIRECTION} WHEN 'increasing' THEN true WHEN 'decreasing' THEN false END
    AS business_favorable,
  CASE WHEN {_DIRECTION} = 'insufficient_sample' THEN 'insufficient_sample'
    WHEN n < 8 THEN 'direction_only' WHEN {_SIGNIFICANT} THEN 'trend_not_fluctuation'
    ELSE 'fluctuation' END AS reading FROM mk""")
def h06(spark, d):
    tests = s.mann_kendall(_mixed(spark, d), BY)
    return s.trend_reading(tests, [REVENUE]).select(
        "segment", "n", "direction", "significant", "business_favorable", "reading")


_HHI = """hhi AS (SELECT measure_id, dimension, CASE WHEN min(share) >= 0
  THEN sum(power(share / 100, 2)) END AS hhi FROM rows_ GROUP BY ALL)"""


@query("h07_herfindahl", f"""WITH {ROWS}, {_HHI} SELECT measure_id, dimension, {r4('hhi')} AS hhi,
  CASE WHEN hhi IS NULL THEN 'SKIPPED' ELSE 'APPLIED' END AS status,
  'descriptive' AS classification FROM hhi""")
def h07(spark, d):
    return s.herfindahl(rows(spark, d)).drop("level")


@query("h08_herfindahl_policy", f"""WITH {ROWS}, {_HHI} SELECT measure_id, dimension,
  {r4('hhi')} AS hhi, CASE WHEN hhi >= 0.2 THEN '高集中' WHEN hhi >= 0.1 THEN '中度集中'
    WHEN hhi IS NOT NULL THEN '分散' END AS level, 'policy' AS classification FROM hhi""")
def h08(spark, d):
    return s.herfindahl(rows(spark, d), 0.1, 0.2).drop("status")


_CONCENTRATION = f"""WITH {CUSTOMER_SUMS}, k AS (SELECT count(*) AS members,
  100 * sum(v) FILTER (WHERE place <= 5) / any_value(total) AS top5,
  100 * sum(v) FILTER (WHERE place <= 10) / any_value(total) AS top10,
  count(*) FILTER (WHERE cum / total < 0.5) + 1 AS n50,
  count(*) FILTER (WHERE cum / total < 0.8) + 1 AS n80 FROM placed)"""


@query("h09_concentration", f"""{_CONCENTRATION} SELECT 'OK' AS status, members,
  {r4('100.0')} AS coverage_pct, {r4('top5')} AS top5_share, {r4('top10')} AS top10_share,
  {r4('top5')} AS top5_share_identified, n50, n80 FROM k""")
def h09(spark, d):
    return g.concentration(customer_facts(spark, d), REVENUE, "customer").select(
        "status", "members", "coverage_pct", "top5_share", "top10_share",
        "top5_share_identified", "n50", "n80")


@query("h09_concentration_low_coverage", f"""WITH {SALES}, s AS (
  SELECT CASE WHEN region = 'ASIA' THEN customer END AS buyer, revenue FROM sales
  WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'),
k AS (SELECT buyer, sum(revenue) AS v, row_number() OVER (ORDER BY sum(revenue) DESC, buyer)
    AS place FROM s WHERE buyer IS NOT NULL GROUP BY buyer)
SELECT 'BLOCKED' AS status, 'coverage_below_threshold' AS reason_code,
  {r4('100 * sum(v) / (SELECT sum(revenue) FROM s)')} AS coverage_pct,
  {r4('100 * sum(v) FILTER (WHERE place <= 5) / (SELECT sum(revenue) FROM s)')} AS top5_share
FROM k""")
def h09_low(spark, d):
    df = sales(spark, d).withColumn("buyer", F.when(F.col("region") == "ASIA", F.col("customer")))
    some = a.member_facts(df, [REVENUE], ["buyer"], lock_of(df), TIME)
    return g.concentration(some, REVENUE, "buyer").select(
        "status", "reason_code", "coverage_pct", "top5_share")


@query("h10_top5_policy", f"""{_CONCENTRATION} SELECT {r4('top5')} AS top5_share,
  CASE WHEN top5 >= 30 THEN '高' WHEN top5 >= 1 THEN '中' ELSE '低' END AS level,
  'policy' AS classification FROM k""")
def h10(spark, d):
    row = g.concentration(customer_facts(spark, d), REVENUE, "customer")
    return s.top5_level(row, 1, 30).select("top5_share", "level", "classification")


@query("h10_single_threshold", f"""{_CONCENTRATION} SELECT {r4('top5')} AS top5_share,
  CASE WHEN top5 >= 1 THEN 'high' ELSE 'below_high_threshold' END AS level FROM k""")
def h10_single(spark, d):
    return g.concentration(customer_facts(spark, d), REVENUE, "customer",
                           Thresholds(customer_top5_high=1.0)).select("top5_share", "level")


_HIGHER = " OR ".join(f"measure_id = '{m}'" for m, x in DIRECTION.items()
                      if x == "higher_is_better")
_SCAN = f"""scan AS (SELECT *, CASE WHEN ({_HIGHER}) = (change_pct < 0) THEN 'unfavorable'
    ELSE 'favorable' END AS verdict FROM rows_
  WHERE abs(change_pct) >= 15 AND change_pct <> 0
    AND (CASE WHEN share IS NOT NULL THEN share >= 2
      ELSE measure_id NOT IN ('revenue', 'quantity') END))"""


@query("h11_dimension_scan", f"""WITH {ROWS}, {_SCAN} SELECT measure_id, dimension, name,
  {r4('change_pct')} AS change_pct, {r4('share')} AS share, {r4('delta')} AS delta, verdict
FROM scan""")
def h11(spark, d):
    return s.dimension_scan(rows(spark, d), CONTRACT).drop("contribution_pp")


@query("h12_contributions", f"""WITH {ROWS} SELECT measure_id, dimension, name,
  {r4('contribution_pp')} AS contribution_pp, row_number() OVER (
    PARTITION BY measure_id, dimension ORDER BY contribution_pp, name) AS place FROM rows_
WHERE contribution_pp IS NOT NULL""")
def h12(spark, d):
    found = s.contribution_rows(rows(spark, d), CONTRACT)
    placed = ranked(found, g.MEMBER_GROUP, [F.col("contribution_pp").asc(), F.col("name").asc()],
                    rank="place")
    return placed.select("measure_id", "dimension", "name", "contribution_pp", "place")


@query("h13_problem_list", f"""WITH {ROWS}, {_SCAN}, m AS (
  SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(revenue) AS value FROM sales
  GROUP BY ALL),
yoy AS (SELECT a.month, (a.value / b.value - 1) * 100 AS value FROM m a
  JOIN m b ON b.month = (a.month - INTERVAL 1 YEAR)::DATE),
{mk_sql('yoy', '')}
SELECT 'adverse_trend' AS type, 'revenue' AS object, NULL::DOUBLE AS impact FROM mk
WHERE {_SIGNIFICANT} AND s < 0
UNION ALL SELECT 'adverse_member', dimension || '=' || name, {r4('delta')} FROM scan
WHERE measure_id = 'revenue' AND verdict = 'unfavorable'
UNION ALL SELECT 'concentration_policy', 'customer', NULL FROM facts, (SELECT 100 *
    (SELECT sum(v) FROM (SELECT sum(revenue) AS v FROM scoped WHERE cur GROUP BY customer
      ORDER BY v DESC LIMIT 5)) / (SELECT sum(revenue) FROM scoped WHERE cur) AS top5) q
WHERE dimension = '(total)' AND measure_id = 'revenue' AND top5 >= 1""")
def h13(spark, d):
    df = sales(spark, d)
    facts, series = a.facts_and_series(df, CONTRACT, (*DIMS, "customer"), lock_of(df), TIME)
    scan = s.dimension_scan(c.member_comparison(facts.where("dimension <> 'customer'"), CONTRACT), CONTRACT)
    yoy = c.yoy_series(series.where(F.col("measure_id") == REVENUE.id), ["measure_id"])
    readings = s.trend_reading(s.mann_kendall(yoy, ["measure_id"]), CONTRACT)
    buyers = facts.where((F.col("measure_id") == REVENUE.id) & F.col("dimension").isin("customer", TOTAL))
    top5 = s.top5_level(g.concentration(buyers, REVENUE, "customer"), 0.5, 1)
    return s.problem_list(scan, readings, CONTRACT, top5).orderBy(*s.problem_order())


@query("h14_method_applicability", f"""WITH {ROWS}, dims AS (SELECT measure_id, dimension,
    count(*) AS members, coalesce(min(current), 0) >= 0 AS clean FROM rows_ GROUP BY ALL),
per AS (SELECT measure_id, max(members) >= 2 AS many, max(members) >= 2 AND bool_and(clean)
    AND measure_id IN ('revenue', 'quantity') AS positive FROM dims GROUP BY measure_id)
SELECT 'topn' AS method, measure_id, CASE WHEN many THEN 'ELIGIBLE' ELSE 'SKIPPED' END AS status,
  CASE WHEN many THEN 'dimension_with_multiple_groups'
    ELSE 'requires_dimension_with_multiple_groups' END AS reason_code FROM per
UNION ALL SELECT 'pareto', measure_id, CASE WHEN positive THEN 'ELIGIBLE' ELSE 'SKIPPED' END,
  CASE WHEN positive THEN 'nonnegative_additive_measure'
    ELSE 'requires_nonnegative_additive_measure' END FROM per
UNION ALL SELECT 'hhi', measure_id, CASE WHEN positive THEN 'ELIGIBLE' ELSE 'SKIPPED' END,
  CASE WHEN positive THEN 'descriptive_only_without_policy'
    ELSE 'requires_nonnegative_additive_measure' END FROM per
UNION ALL SELECT 'mk_trend', 'revenue', 'ELIGIBLE', 'regular_month_series_n_gte_4' FROM sales
HAVING count(DISTINCT date_trunc('month', o_orderdate))
  = date_diff('month', min(o_orderdate), max(o_orderdate)) + 1
UNION ALL SELECT 'pvm', 'revenue', 'OK', NULL FROM scoped
HAVING sum(quantity) FILTER (WHERE cur) > 0 AND sum(quantity) FILTER (WHERE base) > 0""")
def h14(spark, d):
    df = sales(spark, d)
    facts, series = a.facts_and_series(df, CONTRACT, DIMS, lock_of(df), TIME)
    rows = c.member_comparison(facts, CONTRACT)
    return s.method_applicability(rows, series.where(F.col("measure_id") == REVENUE.id), bridge(spark, d, by=()), CONTRACT)
