"""J: quality gates over the supplied tables, with defects derived from the data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from measureloom.catalog.comparisons import facts
from measureloom.catalog.registry import (
    BASE, CONTRACT, CUR, DISCOUNT, H1, QUANTITY, RETURNS, REVENUE, SALES, TIME, facts_sql,
    lock_of, query, r4, rows_sql, sales, table,
)
from measureloom.contract import FieldSpec, Measure, Roles, SchemaContract, Scope, Thresholds
from measureloom.operators import aggregate as a
from measureloom.operators import compare as c
from measureloom.operators import quality as q
from measureloom.operators.scope import last_day, lock_frame

_SCOPE = f"(({CUR}) OR ({BASE}))"
_NOTHING = "NULL::DOUBLE"
PRICE = Measure("price", "price", "sum", "currency", "higher_is_better", "additive", "amount",
                primary=True)


def _finding(severity: str, code: str, subject: str, value: str = _NOTHING,
             threshold: str = _NOTHING) -> str:
    return (f"SELECT {severity} AS severity, '{code}' AS code, {subject} AS subject, "
            f"{r4(value)} AS value, {r4(threshold)} AS threshold")


def _dirty(spark, d):
    """Orders with blanks, unreadable and negative prices, by status and priority."""
    price = (F.when((F.col("o_orderstatus") == "P") & (F.col(TIME) >= F.lit("2000-01-01")),
                    F.lit(None).cast("string"))
             .when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
             .when(F.col("o_orderpriority") == "1-URGENT", F.concat(
                 F.lit("("), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(")")))
             .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return table(spark, d, "orders").select(TIME, "o_orderstatus", "o_orderpriority",
                                            price.alias("price"))


_DIRTY = f"""dirty AS (SELECT o_orderdate, ({CUR}) AS cur, ({BASE}) AS base,
    o_orderstatus = 'P' AND o_orderdate >= DATE '2000-01-01' AS blank,
    o_orderpriority = '5-LOW' AS bad, o_orderpriority = '1-URGENT' AS neg FROM orders),
sides AS (SELECT 'scope' AS side, * FROM dirty WHERE cur OR base UNION ALL
  SELECT 'current', * FROM dirty WHERE cur UNION ALL SELECT 'base', * FROM dirty WHERE base),
counts AS (SELECT side, count(*) AS scope_rows, count(*) FILTER (WHERE blank) AS blank_rows,
    count(*) FILTER (WHERE NOT blank AND bad) AS parse_errors,
    count(*) FILTER (WHERE NOT blank AND neg) AS negatives,
    count(DISTINCT o_orderdate) AS days FROM sides GROUP BY side)"""


def _counts(spark, d):
    df = _dirty(spark, d)
    return q.scope_counts(df, PRICE, lock_of(df, H1), TIME)


@query("j01_empty_gates", _finding("'error'", "empty_current_period", "'current'", "n::DOUBLE")
       + " FROM (SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '2030-01-01') WHERE n = 0"
       + " UNION ALL " + _finding("'error'", "empty_source", "'source'", "n::DOUBLE")
       + " FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0")
def j01(spark, d):
    orders = table(spark, d, "orders")
    scope = Scope(period="2030Q1", data_as_of="2030-03-31")
    price = replace(PRICE, field="o_totalprice")
    counts = q.scope_counts(orders, price, lock_of(orders, scope), TIME)
    return q.empty_current(counts).unionByName(q.empty_source(orders.where("o_totalprice < 0")))


def _texts(spark, d):
    bad = F.when(F.col("o_orderstatus") == "P", F.lit("soon")).when(
        F.col("o_orderpriority") == "5-LOW",
        F.concat(F.date_format(TIME, "yyyy-MM-dd"), F.lit("T01:00:00+08:00"))).otherwise(
        F.date_format(TIME, "yyyy-MM-dd"))
    return table(spark, d, "orders").select(bad.alias("at"), "o_orderstatus", "o_orderpriority")


@query("j02_time_parse_failures", _finding(
    "CASE WHEN pct > 5 THEN 'error' ELSE 'warning' END", "time_parse_failures", "'at'", "pct",
    "5.0") + """ FROM (SELECT 100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) AS pct
  FROM orders) WHERE pct > 0""")
def j02(spark, d):
    return q.time_gates(_texts(spark, d), "at", "Asia/Shanghai")


@query("j03_offset_without_timezone", _finding(
    "'error'", "offset_without_timezone", "'at'", "n::DOUBLE")
    + """ FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'P'
    AND o_orderpriority = '5-LOW') WHERE n > 0""")
def j03(spark, d):
    return q.time_gates(_texts(spark, d), "at").where("code = 'offset_without_timezone'")


@query("j04_blanks_per_period", f"""WITH {_DIRTY} SELECT side, scope_rows, blank_rows,
  {r4('100.0 * blank_rows / scope_rows')} AS blank_pct FROM counts""")
def j04(spark, d):
    return q.measure_quality(_counts(spark, d)).select(
        "side", "scope_rows", "blank_rows", "blank_pct")


@query("j04_blank_gate", f"WITH {_DIRTY}, w AS (SELECT max(100.0 * blank_rows / scope_rows) AS worst "
       "FROM counts) " + _finding(
           "CASE WHEN worst > 5 THEN 'error' ELSE 'warning' END", "measure_blank", "'price'",
           "worst", "5.0") + " FROM w WHERE worst > 0")
def j04_gate(spark, d):
    return q.measure_gates(_counts(spark, d), PRICE).where("code = 'measure_blank'")


@query("j05_parse_errors", f"""WITH {_DIRTY} SELECT side, parse_errors,
  {r4('100.0 * parse_errors / (scope_rows - blank_rows)')} AS parse_error_pct FROM counts""")
def j05(spark, d):
    return q.measure_quality(_counts(spark, d)).select("side", "parse_errors", "parse_error_pct")


def _baskets(spark, d):
    """Order lines without their keys: exact duplicates occur on their own."""
    both = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(TIME, "l_returnflag", "l_linestatus", F.col("l_quantity").alias("price"))


_COPIES = f"""g AS (SELECT o_orderdate, l_returnflag, l_linestatus, l_quantity AS v,
    count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_SCOPE}
  GROUP BY ALL),
s AS (SELECT 'scope' AS side, n, v FROM g UNION ALL SELECT 'current', n, v FROM g WHERE {CUR}
  UNION ALL SELECT 'base', n, v FROM g WHERE {BASE})"""


@query("j06_duplicate_rows", f"""WITH {_COPIES} SELECT side, sum(n)::BIGINT AS scope_rows,
  sum(n - 1)::BIGINT AS duplicate_rows, {r4('100.0 * sum(n - 1) / sum(n)')} AS row_pct,
  {r4('sum(abs(v) * (n - 1))')} AS duplicate_value,
  {r4('100 * sum(abs(v) * (n - 1)) / sum(abs(v) * n)')} AS value_pct FROM s GROUP BY side""")
def j06(spark, d):
    df = _baskets(spark, d)
    return q.duplicate_rows(df, PRICE, lock_of(df), TIME)


@query("j06_duplicate_gate", f"WITH {_COPIES}, m AS (SELECT max(p) AS p FROM (SELECT 100.0 * "
       "sum(n - 1) / sum(n) AS p FROM s GROUP BY side)), w AS (SELECT max(p) AS p FROM (SELECT "
       "100.0 * sum(v * (n - 1)) / sum(v * n) AS p FROM s GROUP BY side)) " + _finding(
           "CASE WHEN m.p > 5 OR w.p > 5 THEN 'error' ELSE 'warning' END", "duplicate_rows",
           "'rows'", "m.p", "5.0") + " FROM m, w WHERE m.p > 0")
def j06_gate(spark, d):
    df = _baskets(spark, d)
    return q.duplicate_gate(q.duplicate_rows(df, PRICE, lock_of(df), TIME))


@query("j07_repeated_ids", _finding("'warning'", "repeated_ids", "'l_orderkey'", "ids::DOUBLE")
       + """ FROM (SELECT count(*) - count(DISTINCT l_orderkey) AS ids, count(*) - (SELECT count(*)
  FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)) AS copies FROM lineitem)
WHERE ids > copies""")
def j07(spark, d):
    return q.repeated_ids(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"),
                          "l_orderkey")


@query("j08_negative_values", f"WITH {_DIRTY} " + " UNION ALL ".join(
    _finding(f"'{s}'", "negative_values", "'price'", "negatives::DOUBLE")
    + " FROM counts WHERE side = 'scope' AND negatives > 0" for s in ("warning", "error")))
def j08(spark, d):
    counts = _counts(spark, d)
    both = q.measure_gates(counts, PRICE).unionByName(
        q.measure_gates(counts, PRICE, Thresholds(negative_policy="block")))
    return both.where("code = 'negative_values'")


@query("j09_observation_completeness", f"WITH {_DIRTY}, p AS (SELECT side, CASE side "
       "WHEN 'current' THEN 100.0 * days / 1000 ELSE 100.0 * days / 2000 END AS pct FROM counts "
       "WHERE side <> 'scope') " + _finding(
           "'error'", "observations_incomplete", "side", "pct", "90.0") + " FROM p WHERE pct < 90")
def j09(spark, d):
    return q.observation_gate(_counts(spark, d), 1000, 2000, "distinct_dates")


@query("j10_weight_coverage", f"""WITH {SALES}, w AS (SELECT count(discount) AS c,
  count(*) FILTER (WHERE list_price > 50000) AS u FROM sales WHERE {_SCOPE})
SELECT 'discount_pct' AS measure_id, c AS candidate_rows, u AS usable_rows,
  {r4('100.0 * u / c')} AS coverage_pct, CASE WHEN 100.0 * u / c < 95 THEN
    'weight_coverage_below_threshold' END AS reason_code,
  CASE WHEN 100.0 * u / c < 95 THEN 'SKIPPED' ELSE 'OK' END AS status FROM w""")
def j10(spark, d):
    df = sales(spark, d).withColumn("list_price", F.when(
        F.col("list_price") > 50000, F.col("list_price")))
    return q.axis_quality(df, [DISCOUNT], lock_of(df), TIME).drop(
        "bad_numerators", "bad_denominators")


@query("j11_ratio_inputs", f"""WITH {SALES}, w AS (SELECT count(*) AS c,
  count(*) FILTER (WHERE flag = 'A') AS t, count(*) FILTER (WHERE quantity < 10) AS b
  FROM sales WHERE {_SCOPE})
SELECT 'return_pct' AS measure_id, c AS candidate_rows, t AS bad_numerators,
  b AS bad_denominators, CASE WHEN t + b > 0 THEN 'ratio_inputs_invalid' END AS reason_code,
  CASE WHEN t + b > 0 THEN 'BLOCKED' ELSE 'OK' END AS status FROM w""")
def j11(spark, d):
    df = sales(spark, d).withColumns({
        "returned": F.when(F.col("flag") != "A", F.col("returned")),
        "quantity": F.when(F.col("quantity") >= 10, F.col("quantity")).otherwise(0.0)})
    primary = replace(RETURNS, primary=True)
    return q.axis_quality(df, [primary], lock_of(df), TIME).drop("usable_rows", "coverage_pct")


_SCHEMA = SchemaContract(
    business_grain="one row per order", primary_key=("o_custkey", TIME),
    fields={
        "price": FieldSpec(required=True, type="number", unit="currency", aggregation="sum"),
        "o_orderstatus": FieldSpec(type="number"),
        TIME: FieldSpec(required=True, type="date"),
        "note": FieldSpec(), "branch": FieldSpec(required=True),
    })


@query("j13_type_drift", f"WITH {_DIRTY}, v AS (SELECT count(*) FILTER (WHERE NOT blank AND NOT bad)"
       " / count(*) FILTER (WHERE NOT blank) AS ratio FROM dirty) "
       + _finding("'error'", "type_drift", "'price'", "ratio", "0.95") + " FROM v WHERE ratio < 0.95"
       + " UNION ALL " + _finding("'warning'", "type_drift", "'o_orderstatus'", "0.0", "0.95")
       + " FROM v")
def j13(spark, d):
    return q.type_drift(_dirty(spark, d), _SCHEMA)


@query("j14_unit_drift", _finding("'error'", "unit_drift", "'price'", "n::DOUBLE", "1.0")
       + " FROM (SELECT count(DISTINCT o_orderstatus) AS n FROM orders) WHERE n > 1")
def j14(spark, d):
    same = replace(PRICE, id="same", unit_field="flag", unit="x")
    df = table(spark, d, "orders").withColumn("flag", F.lit("x"))
    return q.observed_units(df, [replace(PRICE, unit_field="o_orderstatus"), same])


@query("j15_key_duplicates", _finding(
    "'error'", "primary_key_repeated", "'o_custkey,o_orderdate'", "n::DOUBLE")
    + """ FROM (SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM orders
  GROUP BY o_custkey, o_orderdate) WHERE n > 1) WHERE n > 0""")
def j15(spark, d):
    return q.key_duplicates(table(spark, d, "orders"), _SCHEMA)


# ASIA is left out of the parts, one brand is left with nearly everything.
_PARTS = f"""{SALES}, skewed AS (SELECT * REPLACE (CASE WHEN brand = 'Brand#1' THEN revenue * 1e6
  ELSE revenue END AS revenue) FROM sales),
{facts_sql(['revenue'], ['region', 'brand'], source='skewed')}, {rows_sql()}"""


def _parts(spark, d):
    df = sales(spark, d).withColumn("revenue", F.when(
        F.col("brand") == "Brand#1", F.col("revenue") * 1e6).otherwise(F.col("revenue")))
    return a.member_facts(df, [REVENUE], ["region", "brand"], lock_of(df), TIME)


@query("j16_share_sum", f"WITH {_PARTS}, s AS (SELECT measure_id || '.' || dimension AS subject, "
       "sum(share) AS total FROM rows_ WHERE name <> 'ASIA' GROUP BY ALL) " + _finding(
           "'warning'", "shares_do_not_add_up", "subject", "total", "100.0")
       + " FROM s WHERE abs(total - 100) > 1")
def j16(spark, d):
    parts = c.member_comparison(_parts(spark, d), [REVENUE])
    return q.share_sum_gate(parts.where("name <> 'ASIA'"))


@query("j17_weak_dimension", f"WITH {_PARTS}, s AS (SELECT measure_id || '.' || dimension AS subject, "
       "max(share) AS top, count(*) AS n, count(*) FILTER (WHERE share < 2) AS weak FROM rows_ "
       "GROUP BY ALL) " + _finding("'warning'", "weak_dimension", "subject", "top", "90.0")
       + " FROM s WHERE n >= 2 AND n - weak <= 1 AND top > 90")
def j17(spark, d):
    return q.weak_dimensions(c.member_comparison(_parts(spark, d), [REVENUE]))


_RECODED = f"""{SALES}, coded AS (SELECT *, CASE WHEN ({CUR}) AND region <> 'ASIA' THEN
  lower(region) ELSE region END AS zone FROM sales WHERE {_SCOPE}),
m AS (SELECT 'zone' AS dimension, zone AS name, bool_or({CUR}) AS c, bool_or({BASE}) AS b
  FROM coded GROUP BY zone UNION ALL
  SELECT 'segment', segment, bool_or({CUR}), bool_or({BASE}) FROM coded GROUP BY segment),
j AS (SELECT dimension, count(*) FILTER (WHERE c AND b) / count(*) AS jaccard FROM m
  GROUP BY dimension)"""


def _recoded(spark, d):
    df = sales(spark, d)
    late = F.col(TIME) >= F.lit("2000-01-01").cast("timestamp_ntz")
    df = df.withColumn("zone", F.when(late & (F.col("region") != "ASIA"), F.lower("region"))
                       .otherwise(F.col("region")))
    return a.member_facts(df, [REVENUE, QUANTITY], ["zone", "segment"], lock_of(df), TIME)


@query("j18_member_overlap", f"WITH {_RECODED} SELECT dimension, {r4('jaccard')} AS jaccard FROM j")
def j18(spark, d):
    return q.member_overlap(_recoded(spark, d)).select("dimension", "jaccard")


@query("j18_member_drift", f"WITH {_RECODED} " + _finding(
    "'error'", "member_drift", "dimension", "jaccard", "0.5") + " FROM j WHERE jaccard < 0.5")
def j18_gate(spark, d):
    return q.member_drift(_recoded(spark, d))


@query("j19_baseline_missing", _finding(
    "'warning'", "baseline_missing", "'price'", "n::DOUBLE")
    + """ FROM (SELECT count(*) AS n FROM orders WHERE o_orderdate BETWEEN DATE '1994-01-01'
  AND DATE '1994-06-30') WHERE n = 0""")
def j19(spark, d):
    orders = table(spark, d, "orders")
    price = replace(PRICE, field="o_totalprice")
    scope = Scope(period="1995H1", comparison="yoy", data_as_of="1995-06-30",
                  comparison_as_of="1994-06-30")
    lock = lock_of(orders, scope)
    totals = c.total_comparison(a.member_facts(orders, [price], [], lock, TIME), [price])
    return q.baseline_gate(q.scope_counts(orders, price, lock, TIME), totals, price, lock)


@query("j19_baseline_zero", _finding("'warning'", "baseline_zero", "'price'", "total")
       + f""" FROM (SELECT sum(0 * o_totalprice) AS total, count(*) AS n FROM orders WHERE {BASE})
WHERE n > 0 AND total = 0""")
def j19_zero(spark, d):
    late = F.col(TIME) >= F.lit("2000-01-01").cast("timestamp_ntz")
    orders = table(spark, d, "orders").withColumn(
        "price", F.when(late, F.col("o_totalprice")).otherwise(0.0))
    lock = lock_of(orders)
    totals = c.total_comparison(a.member_facts(orders, [PRICE], [], lock, TIME), [PRICE])
    return q.baseline_gate(q.scope_counts(orders, PRICE, lock, TIME), totals, PRICE, lock)


@query("j20_cutoffs", "WITH m AS (SELECT max(o_orderdate)::DATE AS m FROM orders) "
       + _finding("'error'", "baseline_not_covered", "'comparison_as_of'",
                  "date_diff('day', (last_day(m) - INTERVAL 1 YEAR)::DATE, DATE '2000-01-31')")
       + " FROM m WHERE (last_day(m) - INTERVAL 1 YEAR)::DATE > DATE '2000-01-31' UNION ALL "
       + _finding("'error'", "period_inferred", "'period'") + " FROM m")
def j20(spark, d):
    scope = Scope(period="auto", comparison="yoy", data_as_of="2001-12-31",
                  comparison_as_of="2000-01-31")
    return q.cutoff_gate(lock_frame(spark, scope, last_day(table(spark, d, "orders"), TIME)))


@query("j21_status_rollup", f"""WITH {_DIRTY}, c AS (SELECT max(100.0 * blank_rows / scope_rows) AS b,
    max(parse_errors) AS p, max(negatives) AS n,
    max(100.0 * parse_errors / (scope_rows - blank_rows)) FILTER (WHERE side = 'scope') AS pp
  FROM counts),
e AS (SELECT (b > 5)::BIGINT + (p > 0 AND pp > 5)::BIGINT AS errors, (b > 0 AND b <= 5)::BIGINT
    + (p > 0 AND pp <= 5)::BIGINT + (n > 0)::BIGINT AS warnings FROM c)
SELECT CASE WHEN errors > 0 THEN 'BLOCKED' WHEN warnings > 0 THEN 'WARN' ELSE 'OK' END AS status,
  errors, warnings FROM e""")
def j21(spark, d):
    return q.status(q.measure_gates(_counts(spark, d), PRICE))


@query("j21_suppression", f"""WITH {SALES}, {facts_sql(['revenue'], ['region'])}
SELECT name, NULL::DOUBLE AS current, 'BLOCKED' AS data_status FROM facts
WHERE dimension = 'region'""")
def j21_suppressed(spark, d):
    shown = facts(spark, d, (REVENUE,), ("region",)).where("dimension = 'region'").select(
        "name", "current")
    status = q.status(q.measure_gates(_counts(spark, d), PRICE))
    return q.suppress_when_blocked(shown, status, ["current"])
