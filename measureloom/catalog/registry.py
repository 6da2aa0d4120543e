"""Registry, shared inputs and shared SQL fragments of the query catalog."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.contract import TOTAL, Measure, Scope
from measureloom.operators import scope as scoping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NUDGE = 1e-9


# Dates are shown as ISO text, because engines hand them over in different classes.
_WINDOW = ("start", "end", "base_start", "base_end")
DATE_COLUMNS = {
    "a01_csv_scan": ("first_day", "last_day"),
    "a01_csv_declared": ("first_day", "last_day"), "b05": ("first_day", "last_day"),
    "c02_unread": (), "c02": ("first_day", "last_day"), "c06": ("start", "end"), "c15_comparison": ("start",),
    "d02": _WINDOW, "d03": _WINDOW, "d04": _WINDOW, "d09": ("start", "requested_end"),
    "d10": (*_WINDOW, "requested_end"), "e13_monthly": ("month",), "e15": ("month",),
    "f08": ("month",), "g11": ("month",), "g13": ("month",), "g16": ("month",),
    "h03": ("month",), "h04": ("month",), "h05": ("month",),
}


def iso_dates(sql: str, columns: Sequence[str]) -> str:
    if not columns:
        return sql
    shown = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({shown}) FROM ({sql})"


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name, with the SQL that must give the same rows."""

    def keep(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(function(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            dates = next((c for start, c in DATE_COLUMNS.items() if name.startswith(start)), ())
            ORACLES[name] = iso_dates(sql, dates)
        return function

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double, so that engines which sum in another order agree, and show dates as text.

    The tiny shift keeps exact halves from falling to either side.
    """
    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name)
        return c.cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else c

    return df.select(*[shown(f) for f in df.schema.fields])


def r4(expression: str) -> str:
    return f"round(({expression}) + {NUDGE}, 4) + 0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files a query writes; on a cluster under the shared folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), name)


# --- the sales view ----------------------------------------------------------------------------

TIME = "o_orderdate"
DIMS = ("region", "segment", "brand")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its members.

    Members of the buyer are joined to the orders, where date filters have already cut the rows,
    so the lines are only shuffled for the order and for the part; small sides are broadcast when
    their measured size allows it.
    """
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(t("part"), F.col("l_partkey") == F.col("p_partkey")))
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return joined.select(
        TIME, F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("product"),
        F.col("c_custkey").alias("customer"), F.col("l_returnflag").alias("flag"),
        (price * (1 - discount)).alias("revenue"), F.col("l_quantity").alias("quantity"),
        discount.alias("discount"), price.alias("list_price"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
        .alias("returned"))


SALES = """sales AS (
  SELECT o_orderdate, r_name AS region, c_mktsegment AS segment, p_brand AS brand,
         p_type AS product, c_custkey AS customer, l_returnflag AS flag,
         l_extendedprice * (1 - l_discount) AS revenue, l_quantity AS quantity,
         l_discount AS discount, l_extendedprice AS list_price,
         CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""

REVENUE = Measure("revenue", "revenue", "sum", "currency", "higher_is_better", "additive",
                  "amount", primary=True)
QUANTITY = Measure("quantity", "quantity", "sum", "count", "higher_is_better", "additive",
                   "quantity")
DISCOUNT = Measure("discount_pct", "discount", "weighted_mean", "percent", "lower_is_better",
                   "non_additive", "rate", weight_field="list_price", storage_scale="fraction")
RETURNS = Measure("return_pct", None, "ratio", "percent", "lower_is_better", "non_additive",
                  "defect_rate", numerator_field="returned", denominator_field="quantity",
                  storage_scale="fraction")
AVG_PRICE = Measure("avg_price", "list_price", "mean", "currency", "neutral", "non_additive",
                    "price")
MEDIAN_PRICE = Measure("median_price", "list_price", "median", "currency", "neutral",
                       "non_additive", "price")
MIN_PRICE = Measure("min_price", "list_price", "min", "currency", "neutral", "non_additive",
                    "price")
MAX_PRICE = Measure("max_price", "list_price", "max", "currency", "neutral", "non_additive",
                    "price")
LINES = Measure("lines", "list_price", "count", "count", "higher_is_better", "additive", "count")
PRICE_POINTS = Measure("price_points", "list_price", "distinct_count", "count", "neutral",
                       "non_additive", "count")
CONTRACT = (REVENUE, QUANTITY, DISCOUNT, RETURNS)

# SQL of each measure over the rows where {f} holds.
MEASURE_SQL = {
    "revenue": "sum(revenue) FILTER (WHERE {f})",
    "quantity": "sum(quantity) FILTER (WHERE {f})",
    "discount_pct": ("100 * sum(discount * list_price) FILTER (WHERE {f} AND list_price > 0)"
                     " / sum(list_price) FILTER (WHERE {f} AND list_price > 0)"),
    "return_pct": ("100 * sum(returned) FILTER (WHERE {f} AND quantity > 0)"
                   " / sum(quantity) FILTER (WHERE {f} AND quantity > 0)"),
    "avg_price": "avg(list_price) FILTER (WHERE {f})",
    "median_price": "median(list_price) FILTER (WHERE {f})",
    "min_price": "min(list_price) FILTER (WHERE {f})",
    "max_price": "max(list_price) FILTER (WHERE {f})",
    "lines": ("CASE WHEN count(*) FILTER (WHERE {f}) > 0"
              " THEN count(list_price) FILTER (WHERE {f})::DOUBLE END"),
    "price_points": ("CASE WHEN count(*) FILTER (WHERE {f}) > 0"
                     " THEN (count(DISTINCT list_price) FILTER (WHERE {f}))::DOUBLE END"),
}
DIRECTION = {"revenue": "higher_is_better", "quantity": "higher_is_better",
             "discount_pct": "lower_is_better", "return_pct": "lower_is_better"}

H1 = Scope(period="2000H1", comparison="yoy", data_as_of="2000-06-30",
           comparison_as_of="1999-06-30")
CUR = "o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'"
BASE = "o_orderdate BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'"


def lock_of(df: DataFrame, scope: Scope = H1, time: str = TIME) -> scoping.Lock:
    return scoping.resolve(df, scope, time)


def facts_sql(measures: Sequence[str], dims: Sequence[str], cur: str = CUR, base: str = BASE,
              source: str = "sales", total: bool = True) -> str:
    """Body of a CTE with the member facts of several measures and dimensions."""
    parts = []
    for m in measures:
        values = (f"{MEASURE_SQL[m].format(f='cur')} AS current, "
                  f"{MEASURE_SQL[m].format(f='base')} AS baseline, "
                  "count(*) FILTER (WHERE cur) > 0 AS in_current, "
                  "count(*) FILTER (WHERE base) > 0 AS in_base")
        for d in dims:
            parts.append(f"SELECT '{m}' AS measure_id, '{d}' AS dimension, "
                         f"coalesce({d}::VARCHAR, '(空值)') AS name, {values} "
                         f"FROM scoped GROUP BY {d}")
        if total:
            parts.append(f"SELECT '{m}' AS measure_id, '{TOTAL}' AS dimension, "
                         f"'{TOTAL}' AS name, {values} FROM scoped")
    body = " UNION ALL ".join(parts)
    return (f"scoped AS (SELECT *, ({cur}) AS cur, ({base}) AS base FROM {source} "
            f"WHERE ({cur}) OR ({base})), facts AS ({body})")


def rows_sql() -> str:
    """CTE ``rows_`` on top of ``facts``: shares, changes, contributions."""
    additive = "f.measure_id IN ('revenue', 'quantity', 'lines')"
    return f"""
guards AS (SELECT measure_id, dimension,
    min(least(coalesce(current, 0), coalesce(baseline, 0))) < 0 AS neg
  FROM facts GROUP BY ALL),
totals AS (SELECT measure_id, current AS tc, baseline AS tb FROM facts
  WHERE dimension = '{TOTAL}'),
rows_ AS (SELECT f.*,
    CASE WHEN {additive} AND NOT neg THEN current / nullif(tc, 0) * 100 END AS share,
    CASE WHEN {additive} AND NOT neg THEN baseline / nullif(tb, 0) * 100 END AS base_share,
    (current / nullif(baseline, 0) - 1) * 100 AS change_pct,
    current - baseline AS delta,
    CASE WHEN {additive} THEN (current - baseline) / nullif(tb, 0) * 100 END AS contribution_pp
  FROM facts f JOIN guards USING (measure_id, dimension) JOIN totals USING (measure_id)
  WHERE dimension <> '{TOTAL}')"""


def favorable_sql(delta: str, measure: str = "measure_id") -> str:
    higher = ", ".join(f"'{m}'" for m, d in DIRECTION.items() if d == "higher_is_better")
    lower = ", ".join(f"'{m}'" for m, d in DIRECTION.items() if d == "lower_is_better")
    return (f"CASE WHEN {delta} IS NULL THEN NULL "
            f"WHEN {measure} IN ({higher}) THEN {delta} >= 0 "
            f"WHEN {measure} IN ({lower}) THEN {delta} <= 0 END")


# --- the events view ---------------------------------------------------------------------------

WEEK = Scope(period="2024-W03", comparison="wow", data_as_of="2024-01-21",
             comparison_as_of="2024-01-14")
EVENT_CUR = "ts >= DATE '2024-01-15' AND ts < DATE '2024-01-22'"
EVENT_BASE = "ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15'"


def level(inner: str = "sum", outer: str = "ending") -> Measure:
    """Semi-additive level of ``events``: one axis across rows of a day, another across days."""
    return Measure("level", "value", inner, "unit", "neutral", "semi_additive", "inventory",
                   dimension_aggregation=inner, time_aggregation=outer, primary=True)
