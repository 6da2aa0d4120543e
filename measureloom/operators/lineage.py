"""Fingerprints of schema, content and contract, and the drift verdicts built on them."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.contract import Measure, SchemaContract
from measureloom.operators.onerow import attach
from measureloom.operators.quality import FINDINGS, field_rows, schema_rows

SNAPSHOT = ("rows bigint, schema_sha256 string, result_sha256 string, semantic_sha256 string")


def _rows_digest(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Digest of a small configuration table (one row per declared field or measure)."""
    packed = F.to_json(F.sort_array(F.collect_list(F.struct(order, *[
        c for c in rows.columns if c != order]))))
    return rows.agg(F.sha2(packed, 256).alias(name))


def schema_fingerprint(df: DataFrame) -> DataFrame:
    """One row: schema_sha256 over field names and types in order."""
    return _rows_digest(schema_rows(df), "position", "schema_sha256")


#: Bits of a row digest that are summed at once: sums of some 10**13 rows keep within a long.
_WORD_BITS = 20


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count and an order-free digest of the multiset of rows.

    A row is the text of its cells, text cells behind their length, joined by bars, so that any engine
    with MD5 can repeat it; null is a hyphen, and nested values are JSON. 120 bits of the row's MD5 are cut into six words,
    and each word is summed over all rows. Nothing but seven numbers per task is shuffled.
    """
    cells = [_cell_text(f) for f in df.schema.fields]
    digest = F.md5(F.concat_ws("|", *cells))
    half = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("bigint")
    # The generator keeps the digest from being worked out anew for every word.
    halves = df.select(F.explode(F.array(digest)).alias("d")).select(half(1).alias("a"), half(16).alias("b"))
    mask = F.lit((1 << _WORD_BITS) - 1)
    words = [F.coalesce(F.sum(F.shiftright(c, shift).bitwiseAND(mask)), F.lit(0)).alias(f"{c}{shift}")
             for c in "ab" for shift in (40, 20, 0)]
    parts = halves.agg(F.count(F.lit(1)).alias("rows"), *words)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in parts.columns])
    return parts.select("rows", F.sha2(text, 256).alias("result_sha256"))


def _cell_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.MapType, T.VariantType, T.StructType, T.ArrayType)):
        text = F.to_json(c)
    elif isinstance(field.dataType, T.BinaryType):
        text = F.hex(c)
    elif isinstance(field.dataType, T.StringType):
        text = c
    else:
        return F.coalesce(c.cast("string"), F.lit("-"))
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def semantic_fingerprint(spark: SparkSession, measures: Sequence[Measure],
                         contract: SchemaContract | None = None) -> DataFrame:
    """One row: semantic_sha256 over everything that changes the meaning of a number."""
    shown_only = {"label", "target_field", "benchmark", "dimension_aggregation"}
    names = sorted({f.name for f in dataclasses.fields(Measure)} - shown_only | {"within_day"})
    rows = spark.createDataFrame(
        [tuple(None if getattr(m, n) is None else str(getattr(m, n)) for n in names)
         for m in measures], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    contract = contract or SchemaContract()
    fields = _rows_digest(field_rows(spark, contract), "field", "fields")
    grain = F.concat_ws("|", F.lit(contract.business_grain or ""),
                        F.lit(",".join(contract.primary_key or ())))
    return attach(_rows_digest(rows, "id", "measures"), fields).select(
        F.sha2(F.concat_ws("|", "measures", "fields", grain), 256).alias("semantic_sha256"))


def snapshot(df: DataFrame, measures: Sequence[Measure],
             contract: SchemaContract | None = None) -> DataFrame:
    """One row with every fingerprint of a run; keep it to compare the next run with."""
    return attach(content_fingerprint(df), schema_fingerprint(df),
                  semantic_fingerprint(df.sparkSession, measures, contract)).select(
        "rows", "schema_sha256", "result_sha256", "semantic_sha256")


def row_count_drift(current: DataFrame, baseline: DataFrame, warn_pct: float = 10.0,
                    block_pct: float = 30.0) -> DataFrame:
    """Row count against the baseline run: change_pct and OK, WARN, BLOCKED or UNCHANGED."""
    return compare_counts(attach(current.select(F.col("rows").alias("current_rows")),
                                 baseline.select(F.col("rows").alias("baseline_rows"))),
                          warn_pct, block_pct)


def compare_counts(pairs: DataFrame, warn_pct: float = 10.0, block_pct: float = 30.0,
                   keep: Sequence[str] = ()) -> DataFrame:
    """The same for every row of a table of ``baseline_rows`` and ``current_rows``."""
    if not 0 <= warn_pct <= block_pct:
        raise ValueError("thresholds need 0 <= warn <= block")
    base, now = F.col("baseline_rows"), F.col("current_rows")
    change = F.when(base > 0, (now / F.when(base > 0, base) - 1) * 100).when(now == 0, 0.0)
    size = F.abs(change)
    verdict = (F.when(base.isNull(), "BLOCKED")
               .when((base == 0) & (now == 0), "UNCHANGED").when(base == 0, "BLOCKED")
               .when(size > block_pct, "BLOCKED").when(size > warn_pct, "WARN").otherwise("OK"))
    return pairs.select(*keep, "baseline_rows", "current_rows", change.alias("change_pct"),
                        verdict.alias("status"))


def drift(current: DataFrame, baseline: DataFrame, warn_pct: float = 10.0,
          block_pct: float = 30.0, allow_schema: bool = False, allow_semantic: bool = False,
          expected_change: bool | None = None) -> DataFrame:
    """(check_name, state, severity): verdict of schema, meaning, row count and content."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in baseline.columns])
    pair = attach(current, b)

    def changed(name: str) -> Column:
        return ~F.col(name).eqNullSafe(F.col(f"b_{name}"))

    def line(name: str, differs: Column, severity: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"),
                        F.when(differs, "CHANGED").otherwise("UNCHANGED").alias("state"),
                        severity.alias("severity"))

    quiet = F.lit(None).cast("string")
    content = changed("result_sha256")
    on_change = {False: F.lit("error"), None: F.lit("warning"), True: quiet}[expected_change]
    on_same = F.lit("warning") if expected_change is True else quiet
    hashes = pair.select(F.explode(F.array(
        line("schema", changed("schema_sha256"), F.when(
            changed("schema_sha256"), "warning" if allow_schema else "error")),
        line("semantic_contract", changed("semantic_sha256"), F.when(
            changed("semantic_sha256"), "warning" if allow_semantic else "error")),
        line("result_snapshot", content, F.when(content, on_change).otherwise(on_same)),
    )).alias("l")).select("l.*")
    counted = row_count_drift(current, baseline, warn_pct, block_pct).select(
        F.lit("row_count").alias("check_name"), F.col("status").alias("state"),
        F.when(F.col("status") == "BLOCKED", "error").when(F.col("status") == "WARN", "warning")
        .alias("severity"))
    return hashes.unionByName(counted)


def drift_findings(verdicts: DataFrame) -> DataFrame:
    """Drift verdicts as quality findings."""
    return verdicts.where(F.col("severity").isNotNull()).select(
        "severity", F.concat(F.lit("drift_"), F.col("check_name")).alias("code"),
        F.col("state").alias("subject"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("double").alias("threshold")).to(T._parse_datatype_string(FINDINGS))


def drift_status(verdicts: DataFrame) -> DataFrame:
    """OK, WARN or BLOCKED over all drift checks."""
    n = verdicts.agg(F.count_if(F.col("severity") == "error").alias("e"),
                     F.count_if(F.col("severity") == "warning").alias("w"))
    return n.select(F.when(F.col("e") > 0, "BLOCKED").when(F.col("w") > 0, "WARN")
                    .otherwise("OK").alias("status"))


def stamped(derived: DataFrame, source: DataFrame) -> DataFrame:
    """Attach the content digest of the table a result was derived from."""
    digest = content_fingerprint(source).select(F.col("result_sha256").alias("source_sha256"))
    return attach(derived, digest)


def stale(derived: DataFrame, source: DataFrame) -> DataFrame:
    """One row per digest found in ``derived``: is it still the digest of ``source``."""
    now = content_fingerprint(source).select(F.col("result_sha256").alias("current_sha256"))
    found = derived.groupBy("source_sha256").agg(F.count(F.lit(1)).alias("rows"))
    return attach(found, now).withColumn(
        "stale", ~F.col("source_sha256").eqNullSafe(F.col("current_sha256")))


