"""R: whole lifecycles, a report and its insights, held against the SQL of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from measureloom.catalog.registry import (
    BASE, CONTRACT, CUR, DIMS, H1, ORACLES, SALES, TIME, query, r4, sales,
)
from measureloom.contract import FieldSpec, Roles, SchemaContract
from measureloom.plans import Contract, build_report, derive_insights


def _report(spark, d):
    contract = Contract(list(CONTRACT), Roles(time=TIME, dimensions=DIMS), H1)
    return build_report(sales(spark, d), contract, write_once=True)


@query("r01_report_totals", ORACLES["f01_total_comparison"])
def r01(spark, d):
    return _report(spark, d).totals


@query("r02_report_rows", ORACLES["f02_member_comparison"])
def r02(spark, d):
    return _report(spark, d).rows.select("measure_id", "dimension", "name", "current", "baseline",
                                         "change_pct", "delta", "favorable")


@query("r03_insights_scan", f"""SELECT * FROM ({ORACLES["h11_dimension_scan"]})
WHERE measure_id = 'revenue'""")
def r03(spark, d):
    found = derive_insights(_report(spark, d))
    return found.scan.where(F.col("measure_id") == "revenue").drop("contribution_pp")


# Brand#2 of BUILDING has no revenue, ASIA a negative one; the contract declares what the table is not.
@query("r04_report_findings", f"""WITH {SALES}, messy AS (SELECT *, ({CUR}) AS cur, ({BASE}) AS base,
  CASE WHEN brand = 'Brand#2' AND segment = 'BUILDING' THEN NULL WHEN region = 'ASIA' THEN -revenue ELSE revenue END AS v
  FROM sales), inside AS (SELECT * FROM messy WHERE cur OR base)
SELECT 'warning' AS severity, 'role_column_missing' AS code, 'product=no_such' AS subject, NULL::DOUBLE AS value,
  NULL::DOUBLE AS threshold FROM sales HAVING count(*) > 0
UNION ALL SELECT 'error', 'business_grain_missing', 'schema', NULL, NULL FROM sales HAVING count(*) > 0
UNION ALL SELECT 'error', 'ratio_input_undeclared', 'return_pct.' || c, NULL, NULL
  FROM (VALUES ('returned'), ('quantity')) t(c) WHERE (SELECT count(*) FROM sales) > 0
UNION ALL SELECT 'error', 'primary_key_repeated', 'o_orderdate,customer', sum(n), NULL
  FROM (SELECT count(*) AS n FROM sales GROUP BY o_orderdate, customer) WHERE n > 1 HAVING sum(n) > 0
UNION ALL SELECT 'warning', 'declared_field_missing', 'absent', NULL, NULL FROM sales HAVING count(*) > 0
UNION ALL SELECT 'warning', 'type_drift', 'segment', 0.0, 0.95 FROM sales HAVING count(*) > 0
UNION ALL SELECT 'warning', 'measure_blank', 'revenue', {r4('''greatest(
  100.0 * count(*) FILTER (WHERE v IS NULL) / count(*), 100.0 * count(*) FILTER (WHERE v IS NULL AND cur) / count(*) FILTER (WHERE cur),
  100.0 * count(*) FILTER (WHERE v IS NULL AND base) / count(*) FILTER (WHERE base))''')}, 5.0 FROM inside
UNION ALL SELECT 'warning', 'negative_values', 'revenue', count(*) FILTER (WHERE v < 0), NULL FROM inside""")
def r04(spark, d):
    df = sales(spark, d)
    gone = (F.col("brand") == "Brand#2") & (F.col("segment") == "BUILDING")
    df = df.withColumn("revenue", F.when(gone, None).when(F.col("region") == "ASIA", -F.col("revenue")).otherwise(F.col("revenue")))
    schema = SchemaContract(primary_key=("o_orderdate", "customer"), fields={
        "segment": FieldSpec(type="number"), "absent": FieldSpec(type="number", required=False)})
    contract = Contract(list(CONTRACT), Roles(time=TIME, dimensions=DIMS, customer="customer", product="no_such"), H1, schema=schema)
    return build_report(df, contract, write_once=True).findings


@query("r05_problem_list", ORACLES["h13_problem_list"].split("UNION ALL SELECT 'concentration_policy'")[0])
def r05(spark, d):
    return derive_insights(_report(spark, d)).problems
