"""F: totals and members against the baseline, bridges, year over year, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from measureloom.catalog.registry import (
    CONTRACT, DIMS, QUANTITY, REVENUE, SALES, TIME, facts_sql, favorable_sql, lock_of, query, r4,
    rows_sql, sales,
)
from measureloom.contract import Scope
from measureloom.operators import aggregate as a
from measureloom.operators import compare as c
from measureloom.operators import reconcile as r
from measureloom.operators.shape import rank_members
from measureloom.session import cut_lineage

IDS = [m.id for m in CONTRACT]
FACTS = f"{SALES}, {facts_sql(IDS, DIMS)}"
ROWS = f"{FACTS}, {rows_sql()}"


def facts(spark, d, measures=CONTRACT, dims=DIMS):
    df = sales(spark, d)
    return a.member_facts(df, measures, dims, lock_of(df), TIME)


def rows(spark, d, measures=CONTRACT, dims=DIMS):
    """Member rows; the facts are read several times, so they are written once first."""
    return c.member_comparison(cut_lineage(facts(spark, d, measures, dims)), measures)


_TOTALS = """t AS (SELECT measure_id, current, baseline, current - baseline AS change_abs,
  (current / nullif(baseline, 0) - 1) * 100 AS change_pct FROM facts WHERE dimension = '(total)')"""


@query("f01_total_comparison", f"""WITH {FACTS}, {_TOTALS} SELECT measure_id,
  {r4('current')} AS current, {r4('baseline')} AS baseline, {r4('change_abs')} AS change_abs,
  {r4('change_pct')} AS change_pct, {favorable_sql('change_abs')} AS favorable FROM t""")
def f01(spark, d):
    return c.total_comparison(facts(spark, d), CONTRACT)


@query("f02_member_comparison", f"""WITH {ROWS} SELECT measure_id, dimension, name,
  {r4('current')} AS current, {r4('baseline')} AS baseline, {r4('change_pct')} AS change_pct,
  {r4('delta')} AS delta, {favorable_sql('delta')} AS favorable FROM rows_""")
def f02(spark, d):
    return rows(spark, d).select("measure_id", "dimension", "name", "current", "baseline",
                                 "change_pct", "delta", "favorable")


@query("f02_one_sided_members", f"""WITH {SALES}, {facts_sql(
    ['revenue'], ['customer'],
    "o_orderdate BETWEEN DATE '2001-07-01' AND DATE '2001-07-15'",
    "o_orderdate BETWEEN DATE '2000-07-01' AND DATE '2000-07-15'")}, {rows_sql()}
SELECT name, {r4('current')} AS current, {r4('baseline')} AS baseline, in_current, in_base,
  {r4('share')} AS share, {r4('contribution_pp')} AS contribution_pp FROM rows_""")
def f02_one_sided(spark, d):
    df = sales(spark, d)
    scope = Scope(period="2001Q3", comparison="yoy", data_as_of="2001-07-15",
                  comparison_as_of="2000-07-15")
    facts_ = a.member_facts(df, [REVENUE], ["customer"], lock_of(df, scope), TIME)
    return c.member_comparison(facts_, [REVENUE]).select(
        "name", "current", "baseline", "in_current", "in_base", "share", "contribution_pp")


@query("f03_share", f"""WITH {ROWS} SELECT measure_id, dimension, name, {r4('share')} AS share
FROM rows_""")
def f03(spark, d):
    return rows(spark, d).select("measure_id", "dimension", "name", "share")


@query("f03_share_suppressed_on_negative", f"""WITH {SALES}, signed AS (SELECT * REPLACE (
  CASE WHEN flag = 'R' THEN -revenue ELSE revenue END AS revenue) FROM sales),
{facts_sql(['revenue'], ['flag', 'region'], source='signed')}, {rows_sql()}
SELECT dimension, name, {r4('current')} AS current, {r4('share')} AS share FROM rows_""")
def f03_negative(spark, d):
    df = sales(spark, d).withColumn("revenue", F.when(
        F.col("flag") == "R", -F.col("revenue")).otherwise(F.col("revenue")))
    signed = a.member_facts(df, [REVENUE], ["flag", "region"], lock_of(df), TIME)
    return c.member_comparison(signed, [REVENUE]).select("dimension", "name", "current", "share")


@query("f04_contribution", f"""WITH {ROWS} SELECT measure_id, dimension, name,
  {r4('contribution_pp')} AS contribution_pp FROM rows_""")
def f04(spark, d):
    return rows(spark, d).select("measure_id", "dimension", "name", "contribution_pp")


@query("f05_share_shift", f"""WITH {ROWS} SELECT measure_id, dimension, name, {r4('share')} AS share,
  {r4('base_share')} AS base_share, {r4('share - base_share')} AS share_shift_pp,
  abs(share - base_share) >= 1.5 AS material FROM rows_""")
def f05(spark, d):
    return c.share_shift(rows(spark, d))


_PVM = """p AS (SELECT region, sum(revenue) FILTER (WHERE cur) AS v1,
    sum(revenue) FILTER (WHERE base) AS v0, sum(quantity) FILTER (WHERE cur) AS q1,
    sum(quantity) FILTER (WHERE base) AS q0 FROM scoped GROUP BY region),
pvm AS (SELECT *, v1 / q1 AS p1, v0 / q0 AS p0, (q1 - q0) * v0 / q0 AS volume,
    (q1 / q0 - 1) * 100 AS dq, (v1 / q1 / (v0 / q0) - 1) * 100 AS dp FROM p)"""


def bridge(spark, d, by=("region",)):
    df = sales(spark, d)
    return c.price_volume_mix(df, REVENUE, QUANTITY, lock_of(df), TIME, by=by)


@query("f06_price_volume_mix", f"""WITH {FACTS}, {_PVM} SELECT region, {r4('v0')} AS base_value,
  {r4('v1')} AS current_value, {r4('volume')} AS volume_effect,
  {r4('v1 - v0 - volume')} AS price_mix_effect, {r4('dq')} AS qty_change_pct,
  {r4('dp')} AS price_change_pct, 'OK' AS status FROM pvm""")
def f06(spark, d):
    return bridge(spark, d).select(
        "region", "base_value", "current_value", "volume_effect", "price_mix_effect",
        "qty_change_pct", "price_change_pct", "status")


@query("f07_pvm_quadrant", f"""WITH {FACTS}, {_PVM} SELECT region, {r4('dq')} AS qty_change_pct,
  {r4('dp')} AS price_change_pct, CASE WHEN dq >= 0 AND dp >= 0 THEN '量价齐升'
    WHEN dq >= 0 THEN '量增价减' WHEN dp >= 0 THEN '量减价升' ELSE '量价齐跌' END AS quadrant
FROM pvm""")
def f07(spark, d):
    return c.pvm_quadrant(bridge(spark, d)).select(
        "region", "qty_change_pct", "price_change_pct", "quadrant")


MONTHLY = """monthly AS (SELECT 'revenue' AS measure_id, segment,
  date_trunc('month', o_orderdate)::DATE AS month, sum(revenue) AS value FROM sales GROUP BY ALL)"""


def monthly(spark, d, by=("segment",)):
    return a.monthly_series(sales(spark, d), [REVENUE], TIME, by=list(by))


YOY = """yoy AS (SELECT a.measure_id, a.segment, a.month, (a.value / b.value - 1) * 100 AS value
  FROM monthly a JOIN monthly b ON a.segment = b.segment
    AND b.month = (a.month - INTERVAL 1 YEAR)::DATE WHERE b.value > 0 AND a.value >= 0)"""


@query("f08_yoy_series", f"""WITH {SALES}, {MONTHLY}, {YOY}
SELECT measure_id, segment, month, {r4('value')} AS value FROM yoy""")
def f08(spark, d):
    return c.yoy_series(monthly(spark, d), ["measure_id", "segment"])


# --- reconciliation ----------------------------------------------------------------------------

_LEAVES = """leaves AS (SELECT 'measure_results.' || measure_id || '.' || leaf AS path, value
  FROM t, LATERAL (VALUES ('current', current), ('baseline', baseline),
    ('change_abs', change_abs), ('change_pct', change_pct)) v(leaf, value))"""
_CLAIMS = """claims AS (SELECT path, CASE
    WHEN path LIKE '%change_pct' THEN format('{:,.1f}', value) || '%'
    WHEN path LIKE '%.baseline' THEN format('{:,.1f}', value + 1)
    WHEN path LIKE '%return%current' THEN format('{:,.2f}', value) || ' / 2'
    WHEN path LIKE '%discount%current' THEN 'n/a'
    ELSE format('{:,.1f}', value) END AS text FROM leaves
  UNION ALL SELECT path || '.gone', '1.0' FROM leaves WHERE path LIKE '%.change_abs')"""


def metrics(spark, d):
    """Leaves of one run, written once: both sides of a check must hold the same doubles."""
    return cut_lineage(r.metrics_long(c.total_comparison(facts(spark, d), CONTRACT)))


def _claims(leaves):
    path, value = F.col("path"), F.col("value")
    text = (F.when(path.endswith("change_pct"), F.concat(F.format_number(value, 1), F.lit("%")))
            .when(path.endswith(".baseline"), F.format_number(value + 1, 1))
            .when(path.rlike("return.*current$"), F.concat(F.format_number(value, 2), F.lit(" / 2")))
            .when(path.rlike("discount.*current$"), F.lit("n/a"))
            .otherwise(F.format_number(value, 1)))
    gone = leaves.where(path.endswith(".change_abs")).select(
        F.concat("path", F.lit(".gone")).alias("path"), F.lit("1.0").alias("text"))
    return leaves.select("path", text.alias("text")).unionByName(gone)


@query("f09_claim_evidence", f"""WITH {FACTS}, {_TOTALS}, {_LEAVES}, {_CLAIMS}
SELECT path, text, 'finding' AS kind FROM claims WHERE path LIKE '%.gone'""")
def f09(spark, d):
    leaves = metrics(spark, d)
    claims = _claims(leaves).withColumn("kind", F.lit("finding"))
    guess = claims.where(F.col("path").endswith(".gone")).select(
        F.concat("path", F.lit(".guess")).alias("path"), "text", F.lit("hypothesis").alias("kind"))
    return r.unsupported_claims(claims.unionByName(guess), leaves)


@query("f10_shown_numbers", f"""WITH {FACTS}, {_TOTALS}, {_LEAVES}, {_CLAIMS} SELECT path, CASE
  WHEN text = 'n/a' THEN 'no_number' WHEN text LIKE '% / 2' THEN 'several_numbers'
  WHEN path LIKE '%.gone' THEN 'no_value' WHEN path LIKE '%.baseline' THEN 'mismatch'
  ELSE 'match' END AS outcome FROM claims""")
def f10(spark, d):
    leaves = metrics(spark, d)
    return r.shown_numbers(_claims(leaves), leaves).select("path", "outcome")


@query("f11_metric_assertions", f"""WITH {FACTS}, {_TOTALS}, {_LEAVES}
SELECT path, path NOT LIKE '%.baseline' AS ok FROM leaves
UNION ALL SELECT path || '.gone', false FROM leaves WHERE path LIKE '%.change_abs'""")
def f11(spark, d):
    leaves = metrics(spark, d)
    expect = leaves.select("path", F.when(
        F.col("path").endswith(".baseline"), F.col("value") + 1).otherwise(
        F.col("value") + 0.0001).alias("expect"), F.lit(0.001).alias("tolerance"))
    gone = leaves.where(F.col("path").endswith(".change_abs")).select(
        F.concat("path", F.lit(".gone")).alias("path"), F.lit(1.0).alias("expect"),
        F.lit(None).cast("double").alias("tolerance"))
    return r.assert_metrics(expect.unionByName(gone), leaves).select("path", "ok")


@query("f12_result_diff", f"""WITH {FACTS}, {_TOTALS}, {_LEAVES}
SELECT 'measure_results' AS category, k AS kind, count(*) AS changes FROM (
  SELECT 'changed' AS k FROM leaves WHERE path LIKE '%.baseline'
  UNION ALL SELECT 'added' FROM leaves WHERE path LIKE '%.change_abs'
  UNION ALL SELECT 'removed' FROM leaves WHERE path LIKE '%.change_abs') GROUP BY ALL""")
def f12(spark, d):
    before = metrics(spark, d)
    moved = F.when(F.col("path").endswith(".change_abs"), F.concat("path", F.lit("_new"))
                   ).otherwise(F.col("path"))
    after = before.select(moved.alias("path"), F.when(
        F.col("path").endswith(".baseline"), F.col("value") + 1).otherwise(F.col("value"))
        .alias("value"))
    return r.diff_summary(r.diff_results(before, after))


@query("f13_series_alignment", f"""WITH {SALES}, {MONTHLY}, m AS (SELECT * FROM monthly
  WHERE NOT (segment = 'BUILDING' AND month = DATE '1999-03-01'))
SELECT segment, count(*) AS periods, (SELECT count(DISTINCT month) FROM m) AS all_periods,
  count(*) = (SELECT count(DISTINCT month) FROM m) AS aligned FROM m GROUP BY segment""")
def f13(spark, d):
    series = monthly(spark, d).where(
        ~((F.col("segment") == "BUILDING") & (F.col("month") == F.lit("1999-03-01").cast("date"))))
    return r.series_aligned(series, "segment")


@query("f14_chart_values", f"""WITH {FACTS}, {_TOTALS}, {_LEAVES}
SELECT path, transform, {r4('''CASE transform WHEN 'abs' THEN abs(value) / 10000
  WHEN 'negate' THEN -value / 10000 WHEN 'identity' THEN value / 10000 END''')} AS expected,
  transform <> 'square' AND NOT (path LIKE '%.baseline') AS matched
FROM leaves, (VALUES ('identity'), ('abs'), ('negate'), ('square')) v(transform)""")
def f14(spark, d):
    leaves = metrics(spark, d)
    kinds = F.explode(F.array(*[F.lit(k) for k in ("identity", "abs", "negate", "square")]))
    drawn = leaves.select("path", "value", kinds.alias("transform"))
    value = F.when(F.col("transform") == "abs", F.abs("value")).when(
        F.col("transform") == "negate", -F.col("value")).otherwise(F.col("value"))
    off = F.when(F.col("path").endswith(".baseline"), 1.0).otherwise(0.0)
    bindings = drawn.select("path", "transform", F.lit(0.0001).alias("factor"),
                            F.lit(1e-6).alias("tolerance"), (value * 0.0001 + off).alias("actual"))
    return r.chart_values(bindings, leaves).select("path", "transform", "expected", "matched")


def ranked_rows(spark, d, measures=CONTRACT, dims=DIMS):
    return rank_members(rows(spark, d, measures, dims))
