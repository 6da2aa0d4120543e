"""A: readers and writers, fed with the supplied tables."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from measureloom.catalog.registry import (
    CONTRACT, DIMS, SALES, TIME, facts_sql, lock_of, query, r4, sales, scratch, table,
)
from measureloom.contract import FieldSpec, SchemaContract
from measureloom.operators.aggregate import member_facts
from measureloom.operators.compare import total_comparison
from measureloom.operators.quality import type_drift
from measureloom.sources import fingerprint, sinks
from measureloom.sources.databases import read_duckdb, read_sqlite
from measureloom.sources.files import load, read_csv, read_parquet, read_sql

_BY_STATUS = f"""SELECT o_orderstatus, count(*) AS orders, {r4('sum(o_totalprice)')} AS total,
  CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
FROM orders GROUP BY o_orderstatus"""


def _by_status(orders):
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"),
        F.to_date(F.min("o_orderdate")).alias("first_day"),
        F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("a01_csv_scan", _BY_STATUS)
def csv_scan(spark, d):
    folder = scratch(spark, "orders.csv")
    table(spark, d, "orders").write.option("header", True).option("sep", ";").csv(folder)
    return _by_status(read_csv(spark, folder))


@query("a01_csv_declared_types", _BY_STATUS)
def csv_declared(spark, d):
    folder = scratch(spark, "orders.tsv")
    table(spark, d, "orders").write.option("header", True).option("sep", "\t").csv(folder)
    declared = SchemaContract(fields={
        "o_orderkey": FieldSpec(type="integer"), "o_custkey": FieldSpec(type="integer"),
        "o_totalprice": FieldSpec(type="number"), "o_orderdate": FieldSpec(type="datetime")})
    return _by_status(read_csv(spark, folder, contract=declared))


def _under_header(batches):
    """The lines of one file, under a header."""
    yield pa.RecordBatch.from_pydict({"value": ['key,"a note; with, marks",total,status']})
    for batch in batches:
        yield pa.RecordBatch.from_arrays(batch.columns, names=["value"])


def _quoted_totals(spark, d, name, note):
    """Orders written as lines of text, by no CSV writer, in files that begin with a header each."""
    folder = scratch(spark, name)
    orders = table(spark, d, "orders")
    marked = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = orders.select(F.concat_ws(",", "o_orderkey", marked, F.col("o_totalprice").cast("decimal(18,2)"),
                                      "o_orderstatus").alias("value"))
    lines.repartition(4).mapInArrow(_under_header, "value string").write.text(folder)
    return read_csv(spark, folder).groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total").alias("total"),
        F.min("a note; with, marks").alias("first_note"))


@query("a01_csv_quoted", f"""SELECT o_orderstatus AS status, count(*) AS orders,
  {r4('sum(o_totalprice)')} AS total, min(o_orderpriority || ' "' || o_orderstatus || '", Ltd; x') AS first_note
FROM orders GROUP BY o_orderstatus""")
def csv_quoted(spark, d):
    return _quoted_totals(spark, d, "quoted.csv", F.concat(
        "o_orderpriority", F.lit(' "'), "o_orderstatus", F.lit('", Ltd; x')))


@query("a01_csv_multiline", f"""SELECT o_orderstatus AS status, count(*) AS orders,
  {r4('sum(o_totalprice)')} AS total, min(o_orderpriority || chr(10) || '"' || o_orderstatus || '"') AS first_note
FROM orders GROUP BY o_orderstatus""")
def csv_multiline(spark, d):
    return _quoted_totals(spark, d, "multiline.csv", F.concat(
        "o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('"')))


@query("a01_csv_no_header", f"""SELECT o_orderstatus AS status, count(*) AS orders,
  {r4('sum(o_totalprice)')} AS total, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus""")
def csv_no_header(spark, d):
    folder = scratch(spark, "plain.csv")
    table(spark, d, "orders").select(F.concat_ws(
        ",", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)"), "o_orderstatus").alias("value")).write.text(folder)
    return read_csv(spark, folder).groupBy(F.col("column2").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("column1").alias("total"), F.min("column0").alias("first_key"))


@query("a02_parquet_scan", f"""SELECT o_orderpriority, count(*) AS orders,
  {r4('sum(o_totalprice)')} AS total FROM orders
WHERE o_orderdate >= DATE '2000-01-01' AND o_orderdate < DATE '2000-07-01'
GROUP BY o_orderpriority""")
def parquet_scan(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet")
    return (orders.where("o_orderdate >= date'2000-01-01' and o_orderdate < date'2000-07-01'")
            .groupBy("o_orderpriority")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total")))


_SUPPLIERS = f"""SELECT s_nationkey::BIGINT AS s_nationkey, count(*) AS suppliers,
  {r4('sum(s_acctbal)')} AS balance, min(s_name) AS first_name FROM supplier
GROUP BY s_nationkey"""


def _by_nation(suppliers):
    return suppliers.groupBy(F.col("s_nationkey").cast("bigint").alias("s_nationkey")).agg(
        F.count(F.lit(1)).alias("suppliers"), F.sum("s_acctbal").alias("balance"),
        F.min("s_name").alias("first_name"))


def _shards(df, folder: str, kind: str):
    """Write every partition of ``df`` to a database file of its own."""
    os.makedirs(folder, exist_ok=True)

    def write(frames):
        import uuid

        for frame in frames:
            target = os.path.join(folder, f"{uuid.uuid4().hex}.{kind}")
            if kind == "sqlite":
                import sqlite3

                con = sqlite3.connect(target)
                frame.to_sql("supplier list", con, index=False)
                con.commit()
            else:
                import duckdb

                con = duckdb.connect(target)
                con.register("frame", frame)
                con.execute('CREATE TABLE "supplier list" AS SELECT * FROM frame')
            con.close()
            yield pd.DataFrame({"file": [target]})

    df.repartition(2).mapInPandas(write, "file string").count()
    return folder


@query("a03_sqlite_scan", _SUPPLIERS)
def sqlite_scan(spark, d):
    folder = _shards(table(spark, d, "supplier"), scratch(spark, "sqlite"), "sqlite")
    return _by_nation(read_sqlite(spark, folder, "supplier list", partitions=2))


@query("a04_duckdb_scan", _SUPPLIERS)
def duckdb_scan(spark, d):
    folder = _shards(table(spark, d, "supplier"), scratch(spark, "duckdb"), "duckdb")
    return _by_nation(read_duckdb(spark, folder, "supplier list", partitions=2))


@query("a06_inline_sql", f"""SELECT c_mktsegment, count(*) AS orders,
  {r4('sum(o_totalprice)')} AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment""")
def inline_sql(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("src_orders")
    table(spark, d, "customer").createOrReplaceTempView("src_customer")
    return load(spark, sql="""SELECT c_mktsegment, count(*) AS orders, sum(o_totalprice) AS total
        FROM src_orders JOIN src_customer ON o_custkey = c_custkey
        WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment""")


@query("a06_inline_sql_set_operations", """SELECT c_nationkey::BIGINT AS nationkey,
  'customer_only' AS side FROM (SELECT c_nationkey FROM customer EXCEPT
  SELECT s_nationkey FROM supplier) UNION ALL
SELECT c_nationkey::BIGINT, 'both' FROM (SELECT c_nationkey FROM customer INTERSECT
  SELECT s_nationkey FROM supplier)""")
def inline_sql_sets(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("src_supplier")
    table(spark, d, "customer").createOrReplaceTempView("src_customer")
    return read_sql(spark, """
        SELECT cast(c_nationkey AS bigint) AS nationkey, 'customer_only' AS side FROM (
          SELECT c_nationkey FROM src_customer EXCEPT SELECT s_nationkey FROM src_supplier)
        UNION ALL
        SELECT cast(c_nationkey AS bigint), 'both' FROM (
          SELECT c_nationkey FROM src_customer INTERSECT SELECT s_nationkey FROM src_supplier)""")


_RANGE, _FANOUT = 4096, 64


def _order_files(spark, d) -> str:
    """The orders in sixteen text files, each in the order of its keys."""
    folder = scratch(spark, "orders.txt")
    lines = table(spark, d, "orders").select(
        (F.col("o_orderkey") % 16).alias("part"), "o_orderkey",
        F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy(
        "part").text(folder)
    return folder


def _joined(source: str, up: str) -> str:
    return f"""{up} AS (SELECT part, bytes, nr // 64 AS nr, CASE WHEN count(*) = 1 THEN max(sha)
  ELSE sha256(string_agg(sha, '' ORDER BY nr)) END AS sha FROM {source} GROUP BY part, bytes, nr // 64)"""


# Ranges of 4,096 bytes are hashed, then up to 64 digests at a time; three levels are more than enough.
_FILE_DIGESTS = f"""content AS (SELECT o_orderkey % 16 AS part, string_agg(
    o_orderkey || ',' || o_custkey || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS text
  FROM orders GROUP BY o_orderkey % 16),
leaves AS (SELECT part, bytes, nr, sha256(substr(text, CAST(nr * 4096 + 1 AS BIGINT), 4096)) AS sha FROM (
  SELECT part, text, CAST(length(text) AS BIGINT) AS bytes, unnest(range((length(text) + 4095) // 4096)) AS nr
  FROM content)),
{_joined('leaves', 'up1')}, {_joined('up1', 'up2')}, {_joined('up2', 'up3')}"""


@query("a07_source_fingerprint", f"""WITH {_FILE_DIGESTS},
parts AS (SELECT substr(sha, 1, 3) AS p, sha256(string_agg(sha, '' ORDER BY sha)) AS d, count(*) AS n,
  sum(bytes) AS b FROM up3 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes, sha256(string_agg(d, '' ORDER BY p)) AS sha256,
  'source_file_snapshot' AS fingerprint_scope FROM parts""")
def source_digest(spark, d):
    return fingerprint.source_fingerprint(spark, _order_files(spark, d), None, _RANGE, _FANOUT).select(
        "files", "bytes", "sha256", "fingerprint_scope")


@query("a07_file_fingerprints", f"WITH {_FILE_DIGESTS} SELECT part, bytes, sha AS sha256 FROM up3")
def file_digests(spark, d):
    return fingerprint.file_fingerprints(spark, _order_files(spark, d), _RANGE, _FANOUT).select(
        F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), "bytes", "sha256")


@query("a08_metrics_sink", f"""WITH {SALES}, {facts_sql(list(m.id for m in CONTRACT), DIMS)}
SELECT measure_id, {r4('current')} AS current, {r4('baseline')} AS baseline FROM facts
WHERE dimension = '(total)'""")
def metrics_sink(spark, d):
    df = sales(spark, d)
    totals = total_comparison(
        member_facts(df, CONTRACT, DIMS, lock_of(df), TIME), CONTRACT)
    path = scratch(spark, "metrics")
    sinks.write_metrics(totals, path)
    return read_parquet(spark, path).select("measure_id", "current", "baseline")


@query("a09_findings_sink", """SELECT '- **BLOCKED** type_drift: p_name = 0.0 (limit 0.95)' AS line
FROM (SELECT count(*) AS n FROM part) WHERE n > 0""")
def findings_sink(spark, d):
    declared = SchemaContract(fields={
        "p_name": FieldSpec(type="number", required=True),
        "p_retailprice": FieldSpec(type="number", required=True)})
    path = scratch(spark, "findings")
    sinks.write_findings(type_drift(table(spark, d, "part"), declared), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
