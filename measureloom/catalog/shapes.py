"""G: rankings, boards, concentration and the rows tables and charts consume."""

from __future__ import annotations

from pyspark.sql import functions as F

from measureloom.catalog.comparisons import (
    FACTS, IDS, MONTHLY, ROWS, YOY, _TOTALS, bridge, facts, monthly, ranked_rows, rows,
)
from measureloom.catalog.registry import (
    CONTRACT, RETURNS, REVENUE, SALES, TIME, facts_sql, query, r4, rows_sql, sales,
)
from measureloom.operators import aggregate as a
from measureloom.operators import compare as c
from measureloom.operators import shape as g
from measureloom.operators.onerow import attach
from measureloom.session import cut_lineage

_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY measure_id, dimension
  ORDER BY in_current DESC, current DESC NULLS LAST, baseline DESC NULLS LAST, name) AS rank
  FROM rows_)"""


@query("g01_member_rank", f"""WITH {ROWS}, {_RANKED} SELECT measure_id, dimension, name,
  {r4('current')} AS current, rank FROM ranked""")
def g01(spark, d):
    return ranked_rows(spark, d).select("measure_id", "dimension", "name", "current", "rank")


_CUSTOMERS = f"{SALES}, {facts_sql(['revenue'], ['customer'])}, {rows_sql()}"


@query("g01_customer_rank", f"""WITH {_CUSTOMERS}, {_RANKED} SELECT name, {r4('current')} AS current,
  {r4('baseline')} AS baseline, rank FROM ranked""")
def g01_customers(spark, d):
    return ranked_rows(spark, d, (REVENUE,), ("customer",)).select(
        "name", "current", "baseline", "rank")


def _board_sql(where: str, order: str) -> str:
    return f"""WITH {ROWS} SELECT * FROM (SELECT measure_id, dimension, name, {r4('delta')} AS delta,
  {r4('contribution_pp')} AS contribution_pp, row_number() OVER (
    PARTITION BY measure_id, dimension ORDER BY {order}, name) AS rank
  FROM rows_ WHERE {where}) WHERE rank <= 5"""


def _board(df):
    return df.select("measure_id", "dimension", "name", "delta", "contribution_pp",
                     F.col("rank").cast("bigint").alias("rank"))


@query("g02_growth_board", _board_sql("delta > 0", "delta DESC"))
def g02_growth(spark, d):
    return _board(g.mover_board(rows(spark, d), "growth", 5))


@query("g02_decline_board", _board_sql("delta < 0", "delta"))
def g02_decline(spark, d):
    return _board(g.mover_board(rows(spark, d), "decline", 5))


@query("g02_full_growth_board", f"""WITH {_CUSTOMERS} SELECT name, {r4('delta')} AS delta,
  row_number() OVER (ORDER BY delta DESC, name) AS rank FROM rows_ WHERE delta > 0""")
def g02_full(spark, d):
    return g.mover_board(rows(spark, d, (REVENUE,), ("customer",)), "growth").select(
        "name", "delta", "rank")


@query("g03_contribution_board",
       _board_sql("contribution_pp IS NOT NULL", "abs(contribution_pp) DESC"))
def g03(spark, d):
    return _board(g.contribution_board(rows(spark, d), 5))


CUSTOMER_SUMS = f"""{SALES}, known AS (SELECT customer::VARCHAR AS name, sum(revenue) AS v
  FROM sales WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' GROUP BY customer),
placed AS (SELECT *, row_number() OVER (ORDER BY v DESC, name) AS place,
  sum(v) OVER (ORDER BY v DESC, name ROWS UNBOUNDED PRECEDING) AS cum,
  sum(v) OVER () AS total FROM known)"""


def customer_facts(spark, d):
    return cut_lineage(facts(spark, d, (REVENUE,), ("customer",)))


@query("g04_top_shares", f"""WITH {CUSTOMER_SUMS} SELECT count(*) AS members,
  {r4('100 * sum(v) FILTER (WHERE place <= 5) / any_value(total)')} AS top5_share,
  {r4('100 * sum(v) FILTER (WHERE place <= 10) / any_value(total)')} AS top10_share FROM placed""")
def g04(spark, d):
    return g.concentration(customer_facts(spark, d), REVENUE, "customer").select(
        "members", "top5_share", "top10_share")


@query("g05_pareto_members", f"""WITH {CUSTOMER_SUMS}
SELECT count(*) FILTER (WHERE cum / total < 0.5) + 1 AS n50,
  count(*) FILTER (WHERE cum / total < 0.8) + 1 AS n80 FROM placed""")
def g05(spark, d):
    return g.concentration(customer_facts(spark, d), REVENUE, "customer").select("n50", "n80")


@query("g05_pareto_curve", f"""WITH {CUSTOMER_SUMS} SELECT name, {r4('v')} AS value, place AS rank,
  {r4('100 * cum / total')} AS cumulative_pct FROM placed""")
def g05_curve(spark, d):
    known = customer_facts(spark, d).where("dimension = 'customer' and current is not null").select(
        "name", F.col("current").alias("value"))
    return g.pareto_curve(known).select("name", "value", "rank", "cumulative_pct")


@query("g06_order_and_limit", f"""WITH {_CUSTOMERS} SELECT name, {r4('change_pct')} AS change_pct
FROM rows_ ORDER BY change_pct DESC NULLS LAST, name LIMIT 25""")
def g06(spark, d):
    return g.ordered_limit(rows(spark, d, (REVENUE,), ("customer",)), "change_pct", 25).select(
        "name", "change_pct")


@query("g07_extreme_split", f"""WITH {_CUSTOMERS}, s AS (SELECT 'revenue' AS measure_id,
    'customer' AS dimension, name, CASE WHEN name = (SELECT arg_max(name, current) FROM rows_)
      THEN current * 1000 ELSE current END AS v FROM rows_ WHERE current IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY abs(v) DESC, name) AS place, count(*) OVER () AS n
  FROM s)
SELECT name, {r4('v')} AS value, place = 1 AND n >= 3 AND v > 0
  AND v >= 20 * (SELECT v FROM o WHERE place = 2) AS extreme FROM o""")
def g07(spark, d):
    base = rows(spark, d, (REVENUE,), ("customer",))
    lead = base.agg(F.max_by("name", "current").alias("lead"))
    grown = attach(base, lead).where("current is not null").select(
        "measure_id", "dimension", "name",
        F.when(F.col("name") == F.col("lead"), F.col("current") * 1000).otherwise(
            F.col("current")).alias("value"))
    return g.extreme_split(grown, g.MEMBER_GROUP, "value").select("name", "value", "extreme")


@query("g08_trailing_negative_run", f"""WITH {SALES}, {MONTHLY}, {YOY},
o AS (SELECT segment, value, year(month) * 12 + month(month) AS i,
  max(year(month) * 12 + month(month)) OVER (PARTITION BY segment) AS last,
  row_number() OVER (PARTITION BY segment ORDER BY month DESC) AS back FROM yoy),
stops AS (SELECT segment, min(back) AS stop FROM o WHERE value >= 0 OR i <> last - back + 1
  GROUP BY segment)
SELECT o.segment, coalesce(any_value(stop) - 1, count(*)) AS trailing_negative
FROM o LEFT JOIN stops USING (segment) GROUP BY o.segment""")
def g08(spark, d):
    by = ["measure_id", "segment"]
    return g.trailing_negative_run(c.yoy_series(monthly(spark, d), by), ["segment"])


@query("g09_regular_months", f"""WITH {SALES}, m AS (SELECT region, segment,
  date_trunc('month', o_orderdate)::DATE AS month FROM sales
  WHERE NOT (region = 'ASIA' AND month(o_orderdate) = 2) GROUP BY ALL)
SELECT region, segment, count(*) AS n, count(*) >= 4
  AND count(*) = date_diff('month', min(month), max(month)) + 1 AS regular
FROM m GROUP BY ALL""")
def g09(spark, d):
    df = sales(spark, d).where(~((F.col("region") == "ASIA") & (F.month(TIME) == 2)))
    series = a.monthly_series(df, [REVENUE], TIME, by=["region", "segment"])
    return g.regular_months(series, ["region", "segment"])


@query("g10_waterfall", f"""WITH {FACTS}, b AS (SELECT region,
    sum(revenue) FILTER (WHERE base) AS v0, sum(revenue) FILTER (WHERE cur) AS v1,
    (sum(quantity) FILTER (WHERE cur) - sum(quantity) FILTER (WHERE base))
      * sum(revenue) FILTER (WHERE base) / sum(quantity) FILTER (WHERE base) AS vol
  FROM scoped GROUP BY region),
s AS (SELECT region, 0 AS step, 'baseline' AS label, 0 AS "start", v0 AS "end" FROM b
  UNION ALL SELECT region, 1, 'volume', v0, v0 + vol FROM b
  UNION ALL SELECT region, 2, 'price_mix', v0 + vol, v1 FROM b
  UNION ALL SELECT region, 3, 'current', 0, v1 FROM b)
SELECT region, step, label, {r4('"start"')} AS "start", {r4('"end"')} AS "end",
  {r4('CASE WHEN step IN (0, 3) THEN 0 ELSE least("start", "end") END')} AS base,
  {r4('CASE WHEN step IN (1, 2) AND "end" >= "start" THEN "end" - "start" END')} AS increase,
  {r4('CASE WHEN step IN (1, 2) AND "end" < "start" THEN "start" - "end" END')} AS decrease,
  {r4('CASE WHEN step IN (0, 3) THEN "end" END')} AS total FROM s""")
def g10(spark, d):
    return g.waterfall(g.bridge_steps(bridge(spark, d), ["region"]), ["region"])


@query("g11_heat_table", f"""WITH {SALES}, {MONTHLY}
SELECT segment, month, {r4('value')} AS value,
  {r4('(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())')} AS ratio
FROM monthly""")
def g11(spark, d):
    return g.heat_table(monthly(spark, d)).select("segment", "month", "value", "ratio")


@query("g12_value_domain", f"""WITH {SALES}, {MONTHLY} SELECT segment,
  {r4('min(value) - (max(value) - min(value)) * 0.08')} AS low,
  {r4('max(value) + (max(value) - min(value)) * 0.08')} AS high FROM monthly GROUP BY segment""")
def g12(spark, d):
    return g.value_domain(monthly(spark, d), ["segment"])


@query("g12_percent_domain", f"""WITH {SALES}, p AS (SELECT segment, region,
  100 * sum(returned) / sum(quantity) AS v FROM sales GROUP BY ALL)
SELECT segment, {r4('greatest(0, 0 - max(v) * 0.08)')} AS low,
  {r4('least(100, max(v) * 1.08)')} AS high FROM p GROUP BY segment""")
def g12_percent(spark, d):
    rates = a.grouped(sales(spark, d), [RETURNS], ["segment", "region"])
    return g.value_domain(rates, ["segment"], "return_pct", zero_baseline=True,
                          bounded_percent=True)


@query("g13_small_multiples", f"""WITH {SALES}, {MONTHLY} SELECT segment AS panel, month,
  {r4('value')} AS value,
  {r4('min(value) OVER () - (max(value) OVER () - min(value) OVER ()) * 0.08')} AS low,
  {r4('max(value) OVER () + (max(value) OVER () - min(value) OVER ()) * 0.08')} AS high
FROM monthly""")
def g13(spark, d):
    return g.small_multiples(monthly(spark, d), "segment").drop("measure_id")


@query("g14_bullet_rows", f"""WITH {SALES}, {facts_sql(['revenue'], ['segment'])}
SELECT name, {r4('current')} AS actual, {r4('baseline * 1.05')} AS target,
  {r4('current / (baseline * 1.05) * 100')} AS attainment_pct,
  CASE WHEN current >= baseline * 1.05 THEN 'met'
    WHEN current / (baseline * 1.05) >= 0.8 THEN 'near' ELSE 'missed' END AS band
FROM facts WHERE dimension = 'segment'""")
def g14(spark, d):
    both = facts(spark, d, (REVENUE,), ("segment",)).where("dimension = 'segment'")
    return g.bullet_rows(both.select("name", F.col("current").alias("actual")),
                         both.select("name", (F.col("baseline") * 1.05).alias("target")))


@query("g15_rank_table", f"""WITH {_CUSTOMERS} SELECT name, {r4('current')} AS current,
  {r4('change_pct')} AS change_pct FROM rows_
WHERE current IS NOT NULL AND change_pct IS NOT NULL ORDER BY rows_.current DESC, name LIMIT 20""")
def g15(spark, d):
    return g.rank_table(rows(spark, d, (REVENUE,), ("customer",)),
                        ["current", "change_pct"]).select("name", "current", "change_pct")


@query("g16_composition", f"""WITH {SALES}, {MONTHLY} SELECT segment AS name, month,
  {r4('value')} AS value, {r4('100 * value / sum(value) OVER (PARTITION BY month)')} AS share
FROM monthly""")
def g16(spark, d):
    return g.composition(monthly(spark, d), "segment").drop("measure_id")


@query("g17_headline_candidates", f"""WITH {FACTS}, {_TOTALS}, p AS (
  SELECT measure_id, slot, leaf, format, value,
    CASE measure_id {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(IDS))} END AS lead
  FROM t, LATERAL (VALUES (0, 'current', 'auto', current),
    (1, 'change_pct', 'signed_percent', change_pct), (2, 'baseline', 'auto', baseline),
    (3, 'change_abs', 'signed_number', change_abs)) v(slot, leaf, format, value)
  WHERE value IS NOT NULL)
SELECT * FROM (SELECT row_number() OVER (ORDER BY lead, slot) AS position,
  'measure_results.' || measure_id || '.' || leaf AS path, format, {r4('value')} AS value FROM p)
WHERE position <= 6""")
def g17(spark, d):
    totals = c.total_comparison(facts(spark, d), CONTRACT)
    return g.headline_candidates(totals, CONTRACT).withColumn(
        "position", F.col("position").cast("bigint"))


@query("g18_slope_rows", f"""WITH {ROWS}, o AS (SELECT *, row_number() OVER (
    PARTITION BY measure_id, dimension ORDER BY current DESC NULLS LAST, name) AS rank FROM rows_)
SELECT measure_id, dimension, name, {r4('baseline')} AS baseline, {r4('current')} AS current,
  CASE WHEN baseline = current THEN 'unchanged'
    WHEN (measure_id IN ('revenue', 'quantity')) = (current > baseline) THEN 'favorable'
    ELSE 'unfavorable' END AS state, rank
FROM o WHERE rank <= 8 AND current IS NOT NULL AND baseline IS NOT NULL""")
def g18(spark, d):
    return g.slope_rows(rows(spark, d), CONTRACT).withColumn("rank", F.col("rank").cast("bigint"))

