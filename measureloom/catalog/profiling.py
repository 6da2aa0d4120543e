"""B: column profiles, drafted roles and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from measureloom.catalog.registry import query, r4, table
from measureloom.operators import profiling as p

# The orders as a business user would name the columns.
_NAMES = {
    "o_orderkey": "order_id", "o_custkey": "customer_code", "o_orderstatus": "channel",
    "o_totalprice": "sales_amount", "o_orderdate": "order_date", "o_orderpriority": "priority",
    "margin_rate": "margin_rate", "wait_hours": "wait_hours", "unit_price": "unit_price",
    "headcount": "headcount", "plan_value": "plan_value",
}


def _orders(spark, d):
    orders = table(spark, d, "orders").select(
        "*", (F.col("o_totalprice") / 1000000).alias("margin_rate"),
        (F.col("o_totalprice") / 100).alias("wait_hours"),
        F.format_number("o_totalprice", 2).alias("unit_price"),
        (F.col("o_custkey") * 2).alias("headcount"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") + 1).alias("plan_value"))
    return orders.select(*[F.col(k).alias(v) for k, v in _NAMES.items()])


def _cell_sql(column: str) -> str:
    return {
        "margin_rate": "o_totalprice / 1000000", "wait_hours": "o_totalprice / 100",
        "unit_price": "format('{:,.2f}', o_totalprice)", "headcount": "o_custkey * 2",
        "plan_value": "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice + 1 END",
    }.get(column, column)


_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    "margin_rate": "double", "wait_hours": "double", "unit_price": "string",
    "headcount": "bigint", "plan_value": "double",
}
_NUMERIC = [c for c in _TYPES if _TYPES[c] in ("bigint", "double") or c == "unit_price"]
_PROFILE = "prof AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{_NAMES[c]}' AS \"column\", '{_TYPES[c]}' AS type, "
    f"count(*) AS rows, 100.0 * count(*) FILTER (WHERE ({_cell_sql(c)}) IS NULL) / count(*) "
    f"AS null_pct, count(DISTINCT {_cell_sql(c)}) AS distinct_count, "
    f"{str(c in _NUMERIC).lower()} AS numeric FROM orders"
    for i, c in enumerate(_NAMES)) + ")"


# What the names of the columns say, spelled out; margin_rate, wait_hours and priority say nothing about
# their role and go by how many values they have.
_BY_NAME = {"order_id": "id", "customer_code": "customer", "channel": "dimension", "sales_amount": "measure",
            "order_date": "time", "unit_price": "measure", "headcount": "measure", "plan_value": "target"}
_ROLES = f"""roles AS (SELECT *, CASE "column" {' '.join(f"WHEN '{c}' THEN '{r}'" for c, r in _BY_NAME.items())}
  ELSE CASE WHEN numeric AND distinct_count > 0.3 * rows THEN 'measure'
    WHEN distinct_count <= greatest(50, 0.1 * rows) THEN 'dimension' ELSE 'other' END END AS role
  FROM prof)"""
_CANDIDATES = "role = 'dimension' AND distinct_count BETWEEN 2 AND 40"


@query("b01_column_profile", f"""WITH {_PROFILE} SELECT position, "column", type, rows,
  {r4('null_pct')} AS null_pct, distinct_count, numeric FROM prof""")
def column_profile(spark, d):
    return p.column_profile(_orders(spark, d))


@query("b02_role_inference", f"""WITH {_PROFILE}, {_ROLES}
SELECT "column", distinct_count, role FROM roles""")
def role_inference(spark, d):
    return p.infer_roles(p.column_profile(_orders(spark, d))).select(
        "column", "distinct_count", "role")


# Field, type, aggregation, unit, direction and additivity that the names of the measures call for.
_SEMANTICS = """(VALUES ('sales_amount', 'amount', 'sum', 'currency', 'neutral', 'additive'),
  ('margin_rate', 'rate', 'mean', 'percent', 'neutral', 'non_additive'),
  ('wait_hours', 'duration', 'mean', 'hour', 'lower_is_better', 'non_additive'),
  ('unit_price', 'price', 'mean', 'currency_per_unit', 'neutral', 'non_additive'),
  ('headcount', 'people', 'sum', 'person', 'neutral', 'additive')
) t(field, semantic_type, aggregation, unit, direction, additivity)"""


@query("b03_measure_semantics", f"""WITH {_PROFILE}, {_ROLES}, m AS (
  SELECT position, t.* FROM roles JOIN {_SEMANTICS} ON field = "column" WHERE role = 'measure')
SELECT field AS id, field, semantic_type, aggregation, unit, direction, additivity,
  CASE WHEN semantic_type IN ('rate', 'defect_rate') THEN 'confirm_fraction_or_percent' END
    AS storage_scale,
  position = (SELECT arg_min(position, (semantic_type <> 'amount', position)) FROM m) AS "primary"
FROM m""")
def measure_semantics(spark, d):
    return p.infer_measures(p.infer_roles(p.column_profile(_orders(spark, d))))


@query("b04_candidate_dimensions", f"""WITH {_PROFILE}, {_ROLES}
SELECT "column", distinct_count FROM roles WHERE {_CANDIDATES}""")
def candidate_dimensions(spark, d):
    roles = p.infer_roles(p.column_profile(_orders(spark, d)))
    return p.candidate_dimensions(roles).select("column", "distinct_count")


@query("b05_time_coverage", """SELECT CAST(min(o_orderdate) AS DATE) AS first_day,
  CAST(max(o_orderdate) AS DATE) AS last_day, count(DISTINCT year(o_orderdate)) AS years,
  count(DISTINCT date_trunc('month', o_orderdate)) AS months, 0::BIGINT AS unreadable
FROM orders""")
def time_coverage(spark, d):
    return p.time_coverage(table(spark, d, "orders"), "o_orderdate")


@query("b06_suggested_analyses", f"""WITH {_PROFILE}, {_ROLES}
SELECT 'time_comparison' AS analysis, 'order_date' AS "column", 'choose a comparison' AS reason
FROM orders HAVING count(DISTINCT year(o_orderdate)) >= 2
UNION ALL SELECT CASE
    WHEN role = 'customer' THEN 'customer_pareto' WHEN role = 'target' THEN 'attainment'
    WHEN role = 'product' THEN 'product_boards' ELSE 'channel_mix' END,
  "column", CASE
    WHEN role = 'customer' THEN 'top shares and Pareto'
    WHEN role = 'target' THEN 'target against actual'
    WHEN role = 'product' THEN 'ranking, growth and decline' ELSE '100% stack' END
FROM roles WHERE role IN ('customer', 'target', 'product')
  OR ({_CANDIDATES} AND "column" = 'channel')""")
def suggested_analyses(spark, d):
    orders = _orders(spark, d)
    return p.suggested_analyses(p.infer_roles(p.column_profile(orders)),
                                p.time_coverage(orders, "order_date"))


_SAMPLED = ("p_brand", "p_type", "p_size", "p_name")


@query("b07_sample_values", " UNION ".join(
    f"SELECT '{c}' AS \"column\", {end}({c}::VARCHAR) AS sample FROM part"
    for c in _SAMPLED for end in ("min", "max")))
def sample_values(spark, d):
    return p.sample_values(table(spark, d, "part").select(*_SAMPLED))
