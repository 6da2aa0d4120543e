"""K: fingerprints, drift, staleness, coverage and flattening."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from measureloom.catalog.comparisons import FACTS, _CLAIMS, _LEAVES, _TOTALS, _claims, facts, metrics
from measureloom.catalog.registry import CONTRACT, REVENUE, SALES, facts_sql, query, r4, sales, table
from measureloom.contract import FieldSpec, SchemaContract
from measureloom.operators import lineage as k
from measureloom.operators import reconcile as r
from measureloom.operators.onerow import attach

_CONTRACT = SchemaContract("one row per order line", (), {
    "revenue": FieldSpec(required=True, type="number", unit="currency", aggregation="sum")})


# Doubles are written by every engine in its own way, whole ten-thousandths by all alike.
_EXACT = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_CELLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_EXACT, "l_returnflag", "l_linestatus", "l_shipdate")


def _cell_sql(column: str) -> str:
    text = f"CAST({f'CAST(floor({column} * 10000 + 0.5) AS BIGINT)' if column in _EXACT else column} AS VARCHAR)"
    return f"coalesce(length({text}) || ':' || {text}, '-')" if column in ("l_returnflag", "l_linestatus") else f"coalesce({text}, '-')"


@query("k02_content_fingerprint", f"""WITH d AS (SELECT md5(concat_ws('|', {', '.join(map(_cell_sql, _LINE_CELLS))})) AS d FROM lineitem),
h AS (SELECT CAST('0x' || substr(d, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(d, 16, 15) AS BIGINT) AS b FROM d)
SELECT count(*) AS rows, sha256(concat_ws('|', count(*), sum((a >> 40) & 1048575), sum((a >> 20) & 1048575),
  sum(a & 1048575), sum((b >> 40) & 1048575), sum((b >> 20) & 1048575), sum(b & 1048575))) AS result_sha256 FROM h""")
def k02(spark, d):
    return k.content_fingerprint(table(spark, d, "lineitem").select(
        *[F.floor(F.col(c) * 10000 + 0.5).cast("bigint").alias(c) if c in _EXACT else F.col(c) for c in _LINE_CELLS]))


@query("k02_order_free", """SELECT count(*) AS rows, true AS same_when_reordered,
  false AS same_when_doubled FROM lineitem""")
def k02_order_free(spark, d):
    lines = table(spark, d, "lineitem")
    one = k.content_fingerprint(lines)
    other = k.content_fingerprint(lines.repartition("l_partkey")).select(
        F.col("result_sha256").alias("reordered"))
    double = k.content_fingerprint(lines.unionByName(lines)).select(
        F.col("result_sha256").alias("doubled"))
    return attach(one, other, double).select(
        "rows", (F.col("result_sha256") == F.col("reordered")).alias("same_when_reordered"),
        (F.col("result_sha256") == F.col("doubled")).alias("same_when_doubled"))


def _orders(spark, d, year):
    """Orders of one year, by a range that reaches the scan."""
    return table(spark, d, "orders").where(
        f"o_orderdate >= date'{year}-01-01' and o_orderdate < date'{year + 1}-01-01'")


@query("k04_row_drift", f"""WITH n AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders
  GROUP BY ALL), p AS (SELECT b.y AS base_year, b.n AS b, c.n AS c, (c.n / b.n - 1) * 100 AS pct
  FROM n b JOIN n c ON c.y = b.y + 1)
SELECT base_year, b AS baseline_rows, c AS current_rows, {r4('pct')} AS change_pct,
  CASE WHEN abs(pct) > 30 THEN 'BLOCKED' WHEN abs(pct) > 1 THEN 'WARN' ELSE 'OK' END AS status
FROM p""")
def k04(spark, d):
    # One scan counts every year; neighbours are compared as one-row snapshots.
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("rows"))
    before = years.select((F.col("y") + 1).alias("y"), F.col("rows").alias("baseline_rows"))
    pairs = years.withColumnRenamed("rows", "current_rows").join(before, "y").withColumn(
        "base_year", (F.col("y") - 1).cast("bigint"))
    return k.compare_counts(pairs, 1, 30, keep=["base_year"])


def _drift_sql(content: str, content_severity: str) -> str:
    return f"""WITH n AS (SELECT count(*) FILTER (WHERE year(o_orderdate) = 1999) AS b,
  count(*) FILTER (WHERE year(o_orderdate) = 2001) AS c FROM orders)
SELECT 'schema' AS check_name, 'CHANGED' AS state, 'error' AS severity FROM n
UNION ALL SELECT 'semantic_contract', 'CHANGED', 'warning' FROM n
UNION ALL SELECT 'result_snapshot', '{content}', {content_severity} FROM n
UNION ALL SELECT 'row_count', CASE WHEN abs(c / b - 1) > 0.3 THEN 'BLOCKED'
  WHEN abs(c / b - 1) > 0.1 THEN 'WARN' ELSE 'OK' END, CASE WHEN abs(c / b - 1) > 0.3 THEN 'error'
  WHEN abs(c / b - 1) > 0.1 THEN 'warning' END FROM n"""


def _drift(spark, d, expected):
    price = replace(REVENUE, field="o_totalprice")
    before = k.snapshot(_orders(spark, d, 1999), [price], _CONTRACT)
    now = k.snapshot(_orders(spark, d, 2001).withColumn("note", F.lit("x")),
                     [replace(price, direction="neutral")], _CONTRACT)
    return k.drift(now, before, allow_semantic=True, expected_change=expected)


@query("k05_drift_unexpected", _drift_sql("CHANGED", "'error'"))
def k05(spark, d):
    return _drift(spark, d, False)


@query("k05_drift_expected", _drift_sql("CHANGED", "NULL"))
def k05_expected(spark, d):
    return _drift(spark, d, True)


@query("k05_drift_undeclared", _drift_sql("CHANGED", "'warning'"))
def k05_undeclared(spark, d):
    return _drift(spark, d, None)


@query("k06_stale_derivation", f"""WITH {SALES}, {facts_sql(['revenue'], ['region'])}
SELECT v.kind, count(*) AS rows, v.stale FROM facts, (VALUES ('fresh', false), ('changed', true))
  v(kind, stale) GROUP BY ALL""")
def k06(spark, d):
    source = facts(spark, d, (REVENUE,), ("region",)).select(
        "dimension", "name", F.round("current", 4).alias("current"))
    derived = k.stamped(source, source)
    changed = source.withColumn("current", F.col("current") + 1)
    fresh = k.stale(derived, source).select(F.lit("fresh").alias("kind"), "rows", "stale")
    return fresh.unionByName(k.stale(derived, changed).select(
        F.lit("changed").alias("kind"), "rows", "stale"))


@query("k07_number_coverage", f"""WITH {FACTS}, {_TOTALS}, {_LEAVES}, {_CLAIMS},
n AS (SELECT path LIKE '%.current' AS bound, path LIKE '%.baseline' OR path LIKE '%.current'
  AS exempt FROM claims)
SELECT count(*) AS numbers, count(*) FILTER (WHERE bound) AS bound,
  count(*) FILTER (WHERE NOT bound AND exempt) AS exempt,
  {r4('100.0 * count(*) FILTER (WHERE bound OR exempt) / count(*)')} AS coverage_pct FROM n""")
def k07(spark, d):
    claims = _claims(metrics(spark, d)).withColumn("bound", F.col("path").endswith(".current"))
    return r.number_coverage(claims.withColumn(
        "exempt", F.col("bound") | F.col("path").endswith(".baseline")))


@query("k08_flatten", f"""WITH {SALES}, {facts_sql(['revenue'], ['region'])}, p AS (SELECT *,
  row_number() OVER (ORDER BY name) - 1 AS i FROM facts WHERE dimension = 'region')
SELECT 'regions.' || i || '.current' AS path, {r4('current')} AS value FROM p
UNION ALL SELECT 'regions.' || i || '.sides.0', {r4('baseline')} FROM p
UNION ALL SELECT 'regions.' || i || '.sides.1', {r4('current - baseline')} FROM p
UNION ALL SELECT 'total.current', {r4('current')} FROM facts WHERE dimension = '(total)'""")
def k08(spark, d):
    both = facts(spark, d, (REVENUE,), ("region",))
    nested = F.struct("name", "current", F.array(
        "baseline", F.col("current") - F.col("baseline")).alias("sides"))
    packed = both.agg(
        F.array_sort(F.collect_list(F.when(F.col("dimension") == "region", nested)))
        .alias("regions"),
        F.struct(F.max(F.when(F.col("dimension") == "(total)", F.col("current")))
                 .alias("current")).alias("total"))
    return r.flatten(packed)
