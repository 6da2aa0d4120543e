"""Data-quality gates. Each gate returns findings rows
(severity, code, subject, value, threshold); no row means the gate passed.

Gates that look at the same rows are computed together in one aggregate and then unpivoted, so the
locked scope is scanned once for all row-level checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.contract import (
    NULL_MEMBER, NUMERIC_FIELD_TYPES, TIME_FIELD_TYPES, TOTAL, Measure, Roles, SchemaContract,
    Thresholds, primary_of,
)
from measureloom.functions import cleaning
from measureloom.operators.onerow import attach
from measureloom.operators.scope import BASE, CURRENT, Lock, side_flags, tag

FINDINGS = "severity string, code string, subject string, value double, threshold double"
AXIS_QUALITY = ("measure_id string, candidate_rows bigint, usable_rows bigint, coverage_pct double, "
                "bad_numerators bigint, bad_denominators bigint, reason_code string, status string")
# Placeholder texts that do not count as a declared grain.
_GRAIN_PLACEHOLDERS = ("填写业务粒度", "待填写", "TODO")


def findings(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), FINDINGS)


def no_findings(spark: SparkSession) -> DataFrame:
    return findings(spark, [])


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _finding(when: Column, severity: Column | str, code: str, subject: Column | str,
             value: Column, threshold: float | None = None) -> Column:
    """Struct of one finding, null when it does not apply."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(
        as_col(severity).alias("severity"), F.lit(code).alias("code"),
        as_col(subject).alias("subject"), value.cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold")))


def _emit(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    kept = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return df.select(F.explode(kept).alias("f")).select("f.*")


def pct(part: Column, whole: Column) -> Column:
    """Percentage; null on an empty whole."""
    return part / F.when(whole > 0, whole) * 100


def scope_counts(df: DataFrame, measure: Measure, lock: Lock, time: str | None,
                 timezone: str | None = None, judge_all: bool = False) -> DataFrame:
    """Row-level counters per side of the locked scope.

    Columns: side (scope, current, base), scope_rows, filled, blank_rows, parse_errors, negatives,
    days. Only the scope is scanned. With ``judge_all`` the whole table stands in for a scope
    known to be empty, as the gates need something to judge.
    """
    rows = (df.withColumn(CURRENT, F.lit(False)).withColumn(BASE, F.lit(False)) if judge_all
            else tag(df, lock, time, timezone))
    value = cleaning.row_value(rows, measure)
    day = (F.to_date(cleaning.timestamp(rows, time, timezone)) if time
           else F.lit(None).cast("date"))
    needed = rows.select(CURRENT, BASE, value.alias("v"),
                         cleaning.source_present(measure).alias("filled"), day.alias("day"))
    # At most three groups per calendar day; sides are only unfolded after that.
    daily = needed.groupBy("day", CURRENT, BASE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("f"),
        F.count_if(F.col("filled") & F.col("v").isNull()).alias("bad"),
        F.count_if(F.col("v") < 0).alias("neg"))
    sides = F.filter(F.array(F.lit("scope"), F.when(F.col(CURRENT), "current"),
                             F.when(F.col(BASE), "base")), lambda s: s.isNotNull())
    return (daily.select(F.explode(sides).alias("side"), "day", "n", "f", "bad", "neg")
            .groupBy("side").agg(
                F.sum("n").alias("scope_rows"), F.sum("f").alias("filled"),
                (F.sum("n") - F.sum("f")).alias("blank_rows"),
                F.sum("bad").alias("parse_errors"), F.sum("neg").alias("negatives"),
                F.count_distinct("day").alias("days")))


def measure_quality(counts: DataFrame) -> DataFrame:
    """Blank and parse-error percentages per side."""
    return counts.select(
        "side", "scope_rows", "blank_rows", pct(F.col("blank_rows"), F.col("scope_rows"))
        .alias("blank_pct"), "parse_errors",
        pct(F.col("parse_errors"), F.col("filled")).alias("parse_error_pct"), "negatives", "days")


def empty_source(df: DataFrame) -> DataFrame:
    """Error when the table has no rows. Reads at most one row."""
    n = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return _emit(n, [_finding(F.col("n") == 0, "error", "empty_source", "source", F.col("n"))])


def empty_current(counts: DataFrame) -> DataFrame:
    """Error when the locked current period has no rows."""
    n = counts.agg(F.coalesce(F.max(F.when(F.col("side") == "current", F.col("scope_rows"))),
                              F.lit(0)).alias("n"))
    return _emit(n, [_finding(F.col("n") == 0, "error", "empty_current_period", "current",
                              F.col("n"))])


def time_gates(df: DataFrame, time: str, timezone: str | None = None,
               thresholds: Thresholds | None = None) -> DataFrame:
    """Unparsable time values (blocking above the threshold) and offsets without a timezone."""
    limit = (thresholds or Thresholds()).time_parse_block_pct
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(cleaning.timestamp(df, time, timezone).isNull()).alias("bad"),
        F.count_if(cleaning.has_offset(df, time)).alias("aware"))
    share = pct(F.col("bad"), F.col("n"))
    return _emit(counts, [
        _finding(F.col("bad") > 0, F.when(share > limit, "error").otherwise("warning"),
                 "time_parse_failures", time, share, limit),
        _finding(F.lit(timezone is None) & (F.col("aware") > 0), "error",
                 "offset_without_timezone", time, F.col("aware")),
    ])


def measure_gates(counts: DataFrame, measure: Measure,
                  thresholds: Thresholds | None = None) -> DataFrame:
    """Blanks, parse errors and negatives of the primary measure.

    A single side above the blank limit blocks even when the whole scope is below it.
    """
    limits = thresholds or Thresholds()
    quality = measure_quality(counts)
    in_scope = F.col("side") == "scope"
    one = quality.agg(
        F.max(F.when(in_scope, F.col("blank_rows"))).alias("blank"),
        F.max(F.when(in_scope, F.col("blank_pct"))).alias("blank_pct"),
        F.max(F.when(~in_scope, F.col("blank_pct"))).alias("side_blank_pct"),
        F.max(F.when(in_scope, F.col("parse_errors"))).alias("bad"),
        F.max(F.when(in_scope, F.col("parse_error_pct"))).alias("bad_pct"),
        F.max(F.when(in_scope, F.col("negatives"))).alias("negatives"))
    limit = limits.measure_missing_block_pct
    worst = F.greatest("blank_pct", "side_blank_pct")
    parse = limits.measure_parse_block_pct
    block_negative = limits.negative_policy == "block" and measure.semantic_type == "amount"
    return _emit(one, [
        _finding(F.col("blank") > 0, F.when(worst > limit, "error").otherwise("warning"),
                 "measure_blank", measure.id, worst, limit),
        _finding(F.col("bad") > 0,
                 F.when(F.col("bad_pct") > parse, "error").otherwise("warning"),
                 "measure_parse_errors", measure.id, F.col("bad_pct"), parse),
        _finding(F.col("negatives") > 0, "error" if block_negative else "warning",
                 "negative_values", measure.id, F.col("negatives")),
    ])


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of a whole row, equal exactly for equal rows (nulls equal, -0.0 equal 0.0)."""
    parts = []
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            text = F.to_json(c)
        elif isinstance(field.dataType, T.BinaryType):
            text = F.hex(c)
        else:
            text = c.cast("string")
        parts.append(F.coalesce(
            F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


def duplicate_rows(df: DataFrame, measure: Measure, lock: Lock, time: str | None,
                   timezone: str | None = None) -> DataFrame:
    """Exact duplicate rows per side: rows, row_pct, absolute value and value_pct.

    Rows are keyed by a 32-byte digest, so the shuffle carries digests instead of whole rows and
    identical rows are combined before it. Copies beyond the first count as duplicates.
    """
    current, base = side_flags(df, lock, time, timezone)
    if lock.mode != "snapshot" and time is not None:
        df = tag(df, lock, time, timezone).drop(CURRENT, BASE)
    keyed = df.select(
        row_digest(df).alias("digest"), current.alias(CURRENT), base.alias(BASE),
        F.abs(cleaning.row_value(df, measure)).alias("v"))
    copies = keyed.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v"),
        F.any_value(CURRENT).alias(CURRENT), F.any_value(BASE).alias(BASE))
    sides = F.filter(F.array(F.lit("scope"), F.when(F.col(CURRENT), "current"),
                             F.when(F.col(BASE), "base")), lambda s: s.isNotNull())
    tidy = copies.select(F.explode(sides).alias("side"), "n", F.coalesce("v", F.lit(0.0)).alias("v"))
    sums = tidy.groupBy("side").agg(
        F.sum("n").alias("scope_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"),
        F.sum(F.col("v") * F.col("n")).alias("absolute_value"),
        F.sum(F.col("v") * (F.col("n") - 1)).alias("duplicate_value"))
    return sums.select(
        "side", "scope_rows", "duplicate_rows",
        pct(F.col("duplicate_rows"), F.col("scope_rows")).alias("row_pct"), "duplicate_value",
        pct(F.col("duplicate_value"), F.col("absolute_value")).alias("value_pct"))


def duplicate_gate(duplicates: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Duplicates in the scope; blocking when any side is above the row or value limit."""
    limits = thresholds or Thresholds()
    one = duplicates.agg(
        F.max(F.when(F.col("side") == "scope", F.col("duplicate_rows"))).alias("n"),
        F.max("row_pct").alias("row_pct"), F.max("value_pct").alias("value_pct"))
    over = (F.col("row_pct") > limits.duplicate_row_block_pct) | (
        F.coalesce("value_pct", F.lit(0.0)) > limits.duplicate_value_block_pct)
    return _emit(one, [_finding(
        F.col("n") > 0, F.when(over, "error").otherwise("warning"), "duplicate_rows", "rows",
        F.col("row_pct"), limits.duplicate_row_block_pct)])


def repeated_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Warning when ids repeat more often than whole rows do."""
    per = (df.select(row_digest(df).alias("digest"), F.col(f"`{id_column}`").alias("key"))
           .groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")))
    # Identical rows share their id, so ids can be finished from the per-digest counts.
    by_id = per.groupBy("key").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("copies"))
    one = by_id.agg((F.sum("rows") - F.count(F.lit(1))).alias("ids"), F.sum("copies").alias("rows"))
    return _emit(one, [_finding(F.col("ids") > F.col("rows"), "warning", "repeated_ids",
                                id_column, F.col("ids"))])


def observation_gate(counts: DataFrame, expected_current: int, expected_base: int,
                     mode: str = "rows", thresholds: Thresholds | None = None) -> DataFrame:
    """Observed rows or distinct days against what the source should have delivered."""
    if mode not in ("rows", "distinct_dates"):
        raise ValueError("mode is rows or distinct_dates")
    if min(expected_current, expected_base) <= 0:
        raise ValueError("expected observations are positive")
    least = (thresholds or Thresholds()).period_completeness_block_pct
    field = "scope_rows" if mode == "rows" else "days"
    one = counts.agg(*[
        F.coalesce(F.max(F.when(F.col("side") == side, F.col(field))), F.lit(0)).alias(side)
        for side in ("current", "base")])
    entries = []
    for side, expected in (("current", expected_current), ("base", expected_base)):
        ratio = F.col(side) / F.lit(float(expected)) * 100
        entries.append(_finding(ratio < least, "error", "observations_incomplete", side, ratio,
                                least))
    return _emit(one, entries)


def axis_quality(df: DataFrame, measures: Sequence[Measure], lock: Lock, time: str | None,
                 timezone: str | None = None) -> DataFrame:
    """Weight coverage of weighted means and bad inputs of ratios over the scope, one scan.

    Columns: measure_id, candidate_rows, usable_rows, coverage_pct, bad_numerators,
    bad_denominators, reason_codes, status.
    """
    rows = tag(df, lock, time, timezone)
    aggs, structs = [], []
    for m in measures:
        if m.aggregation == "weighted_mean":
            value = cleaning.row_value(rows, m).isNotNull()
            usable = value & (cleaning.number(rows, m.weight_field) > 0)
            counts = (F.count_if(value), F.count_if(usable), F.lit(0), F.lit(0))
        elif m.aggregation == "ratio":
            filled = cleaning.source_present(m)
            top = cleaning.number(rows, m.numerator_field)
            bottom = cleaning.number(rows, m.denominator_field)
            bad_bottom = filled & (bottom.isNull() | (bottom <= 0))
            counts = (F.count_if(filled), F.lit(0), F.count_if(filled & top.isNull()),
                      F.count_if(bad_bottom))
        else:
            continue
        names = [f"_{m.id}_{i}" for i in range(4)]
        aggs += [c.cast("bigint").alias(n) for c, n in zip(counts, names)]
        structs.append((m, names))
    if not structs:
        return df.sparkSession.createDataFrame([], AXIS_QUALITY)
    one = rows.agg(*aggs)
    entries = []
    for m, (candidate, usable, top, bottom) in structs:
        weighted = m.aggregation == "weighted_mean"
        coverage = F.coalesce(pct(F.col(usable), F.col(candidate)), F.lit(0.0))
        if weighted:
            reason = F.when(coverage < m.min_weight_coverage_pct, "weight_coverage_below_threshold")
        else:
            reason = F.when((F.col(top) > 0) | (F.col(bottom) > 0), "ratio_inputs_invalid")
        entries.append(F.struct(
            F.lit(m.id).alias("measure_id"), F.col(candidate).alias("candidate_rows"),
            F.when(F.lit(weighted), F.col(usable)).alias("usable_rows"),
            F.when(F.lit(weighted), coverage).alias("coverage_pct"),
            F.when(F.lit(not weighted), F.col(top)).alias("bad_numerators"),
            F.when(F.lit(not weighted), F.col(bottom)).alias("bad_denominators"),
            reason.alias("reason_code"),
            F.when(reason.isNull(), "OK").otherwise("BLOCKED" if m.primary else "SKIPPED")
            .alias("status")))
    return one.select(F.explode(F.array(*entries)).alias("q")).select("q.*")


def axis_gate(quality: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    primary = primary_of(measures).id
    bad = quality.where(F.col("status") != "OK")
    return bad.select(
        F.when(F.col("measure_id") == primary, "error").otherwise("warning").alias("severity"),
        F.col("reason_code").alias("code"), F.col("measure_id").alias("subject"),
        F.coalesce(F.col("coverage_pct"),
                   (F.col("bad_numerators") + F.col("bad_denominators")).cast("double"))
        .alias("value"), F.lit(None).cast("double").alias("threshold"))


# --- declared schema ---------------------------------------------------------------------------

def schema_rows(df: DataFrame) -> DataFrame:
    """The schema of a table as rows."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, field string, type string")


def field_rows(spark: SparkSession, contract: SchemaContract) -> DataFrame:
    """Declared fields as rows."""
    return spark.createDataFrame(
        [(name, s.required, s.type, s.unit, s.aggregation, float(s.min_valid_ratio))
         for name, s in contract.fields.items()],
        "field string, required boolean, type string, unit string, aggregation string, "
        "min_valid_ratio double")


def missing_fields(df: DataFrame, contract: SchemaContract) -> DataFrame:
    """Declared fields the table lacks: error when required, warning otherwise."""
    declared = field_rows(df.sparkSession, contract)
    return declared.join(schema_rows(df), "field", "left_anti").select(
        F.when(F.col("required"), "error").otherwise("warning").alias("severity"),
        F.lit("declared_field_missing").alias("code"), F.col("field").alias("subject"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"))


def valid_ratios(df: DataFrame, contract: SchemaContract) -> DataFrame:
    """(field, valid_ratio): readable share of filled cells for every declared type, one scan."""
    checks = []
    for name, spec in contract.fields.items():
        if name not in df.columns:
            continue
        kind = (spec.type or "").lower()
        if kind in NUMERIC_FIELD_TYPES:
            checks.append((name, cleaning.number(df, name)))
        elif kind in TIME_FIELD_TYPES:
            checks.append((name, cleaning.timestamp(df, name)))
    if not checks:
        return df.sparkSession.createDataFrame([], "field string, valid_ratio double")
    one = df.agg(*[F.avg(F.when(F.col(f"`{n}`").isNotNull(), c.isNotNull().cast("double")))
                   .alias(f"_{i}") for i, (n, c) in enumerate(checks)])
    tidy = F.array(*[F.struct(F.lit(n).alias("field"),
                              F.coalesce(F.col(f"_{i}"), F.lit(1.0)).alias("valid_ratio"))
                     for i, (n, _) in enumerate(checks)])
    return one.select(F.explode(tidy).alias("r")).select("r.*")


def type_drift(df: DataFrame, contract: SchemaContract) -> DataFrame:
    """Declared types that too few filled cells satisfy."""
    declared = field_rows(df.sparkSession, contract)
    return valid_ratios(df, contract).join(declared, "field").where(
        F.col("valid_ratio") < F.col("min_valid_ratio")).select(
        F.when(F.col("required"), "error").otherwise("warning").alias("severity"),
        F.lit("type_drift").alias("code"), F.col("field").alias("subject"),
        F.col("valid_ratio").alias("value"), F.col("min_valid_ratio").alias("threshold"))


def observed_units(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Unit columns that hold anything but the declared unit; ``value`` is the distinct count.

    All unit columns are looked at in one scan, which leaves one row per measure and unit.
    """
    checked = [m for m in measures if m.unit_field]
    if not checked:
        return no_findings(df.sparkSession)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.trim(F.col(f"`{m.unit_field}`").cast("string")).alias("u"))
                      for i, m in enumerate(checked)])
    seen = df.select(F.explode(cells).alias("c")).where(F.col("c.u") != "").groupBy(
        F.col("c.i").alias("i"), F.col("c.u").alias("u")).agg(F.lit(1).alias("_one"))
    aggs, rules = [], []
    for i, m in enumerate(checked):
        mine = F.col("i") == i
        aggs += [F.count_if(mine).alias(f"n{i}"),
                 F.coalesce(F.every(F.when(mine, F.col("u") == m.unit)), F.lit(False)).alias(f"same{i}")]
        rules.append(_finding(~((F.col(f"n{i}") == 1) & F.col(f"same{i}")), "error", "unit_drift", m.id, F.col(f"n{i}"), 1.0))
    return _emit(seen.agg(*aggs), rules)


def key_duplicates(df: DataFrame, contract: SchemaContract) -> DataFrame:
    """Rows that share their declared primary key with another row."""
    spark = df.sparkSession
    key = list(contract.primary_key or ())
    missing = [k for k in key if k not in df.columns]
    if missing:
        return findings(spark, [("error", "primary_key_missing", k, None, None) for k in missing])
    if not key or contract.allow_duplicate_primary_key:
        return no_findings(spark)
    repeated = (df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > 1))
    one = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return _emit(one, [_finding(F.col("n") > 0, "error", "primary_key_repeated", ",".join(key),
                                F.col("n"))])


def contract_conflicts(spark: SparkSession, contract: SchemaContract, measures: Sequence[Measure],
                       roles: Roles | None = None, declared: bool = True) -> DataFrame:
    """Contradictions between the declared schema, the measures and the roles."""
    found: list[tuple] = []

    def error(code: str, subject: str) -> None:
        found.append(("error", code, subject, None, None))

    if declared:
        grain = (contract.business_grain or "").strip()
        if not grain or grain in _GRAIN_PLACEHOLDERS:
            error("business_grain_missing", "schema")
        if contract.primary_key is None:
            error("primary_key_undeclared", "schema")
    for m in measures:
        spec = contract.fields.get(m.field or "")
        if spec and spec.unit and spec.unit != m.unit:
            error("declared_unit_differs", m.id)
        if spec and spec.aggregation and spec.aggregation.lower() != m.aggregation:
            error("declared_aggregation_differs", m.id)
        if m.aggregation == "ratio":
            for name in (m.numerator_field, m.denominator_field):
                part = contract.fields.get(name or "")
                if declared and part is None:
                    error("ratio_input_undeclared", f"{m.id}.{name}")
                elif part and (part.type or "").lower() not in NUMERIC_FIELD_TYPES:
                    error("ratio_input_not_numeric", f"{m.id}.{name}")
    if roles and roles.amount and roles.amount == roles.qty:
        error("amount_and_quantity_same_column", roles.amount)
    return findings(spark, found)


def missing_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Roles and dimensions whose column the table lacks; what depends on them is dropped."""
    named = df.sparkSession.createDataFrame(
        roles.named_columns() or [], "role string, field string")
    return named.join(schema_rows(df), "field", "left_anti").select(
        F.lit("warning").alias("severity"), F.lit("role_column_missing").alias("code"),
        F.concat_ws("=", "role", "field").alias("subject"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"))


# --- member level ------------------------------------------------------------------------------

def share_sum_gate(rows: DataFrame) -> DataFrame:
    """Shares of a dimension that do not add up to 100 ± 1."""
    sums = rows.groupBy("measure_id", "dimension").agg(F.sum("share").alias("total"))
    return sums.where(F.abs(F.col("total") - 100) > 1).select(
        F.lit("warning").alias("severity"), F.lit("shares_do_not_add_up").alias("code"),
        F.concat_ws(".", "measure_id", "dimension").alias("subject"),
        F.col("total").alias("value"), F.lit(100.0).alias("threshold"))


def weak_dimensions(rows: DataFrame) -> DataFrame:
    """Dimensions where one member holds over 90 % and all others are below 2 %."""
    per = rows.groupBy("measure_id", "dimension").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("share") < 2).alias("weak"),
        F.max("share").alias("top"))
    return per.where((F.col("n") >= 2) & (F.col("n") - F.col("weak") <= 1)
                     & (F.col("top") > 90)).select(
        F.lit("warning").alias("severity"), F.lit("weak_dimension").alias("code"),
        F.concat_ws(".", "measure_id", "dimension").alias("subject"),
        F.col("top").alias("value"), F.lit(90.0).alias("threshold"))


def member_overlap(facts: DataFrame) -> DataFrame:
    """Jaccard overlap of the members of both sides; null members do not count."""
    real = (F.col("dimension") != TOTAL) & (F.col("name") != NULL_MEMBER)
    # A measure id per member repeats the same membership, so it is folded away first.
    members = facts.groupBy("dimension", "name").agg(
        F.max("in_current").alias("c"), F.max("in_base").alias("b"))
    per = members.groupBy("dimension").agg(
        F.count_if(real & F.col("c") & F.col("b")).alias("both"),
        F.count_if(real).alias("either"),
        F.count_if(real & F.col("c")).alias("current_members"),
        F.count_if(real & F.col("b")).alias("base_members"))
    return per.where((F.col("current_members") > 0) & (F.col("base_members") > 0)).withColumn(
        "jaccard", F.col("both") / F.col("either"))


def member_drift(facts: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Dimensions whose members changed so much that the coding is in doubt."""
    limit = (thresholds or Thresholds()).dimension_jaccard_block
    return member_overlap(facts).where(F.col("jaccard") < limit).select(
        F.lit("error").alias("severity"), F.lit("member_drift").alias("code"),
        F.col("dimension").alias("subject"), F.col("jaccard").alias("value"),
        F.lit(float(limit)).alias("threshold"))


def baseline_gate(counts: DataFrame, totals: DataFrame, measure: Measure, lock: Lock) -> DataFrame:
    """Baseline without rows, or with a total of zero."""
    if not lock.has_base:
        return no_findings(counts.sparkSession)
    base_rows = counts.agg(F.coalesce(F.max(F.when(F.col("side") == "base", F.col("scope_rows"))),
                                      F.lit(0)).alias("n"))
    base_total = totals.agg(F.max(F.when(F.col("measure_id") == measure.id, F.col("baseline")))
                            .alias("total"))
    one = attach(base_rows, base_total)
    return _emit(one, [
        _finding(F.col("n") == 0, "warning", "baseline_missing", measure.id, F.col("n")),
        _finding((F.col("n") > 0) & (F.col("total") == 0), "warning", "baseline_zero", measure.id,
                 F.col("total")),
    ])


def cutoff_gate(lock: DataFrame, allow_inferred: bool = False) -> DataFrame:
    """Declared cutoffs against the locked dates; works on the one-row lock."""
    has_base = F.col("base_start").isNotNull()
    number = F.lit(None).cast("double")
    partial = F.col("completeness") != "complete"
    return _emit(lock, [
        _finding(F.col("start").isNull(), "error", "period_unresolved", "period", number),
        _finding(F.col("data_as_of").isNull(), "error", "data_as_of_missing", "data_as_of", number),
        _finding(F.col("data_as_of") < F.col("start"), "error", "data_as_of_before_start",
                 "data_as_of", F.datediff("data_as_of", "start")),
        _finding(has_base & F.col("comparison_as_of").isNull(), "error",
                 "comparison_as_of_missing", "comparison_as_of", number),
        _finding(has_base & (F.col("comparison_as_of") < F.col("base_end")), "error",
                 "baseline_not_covered", "comparison_as_of",
                 F.datediff("comparison_as_of", "base_end")),
        _finding(F.col("data_as_of").isNotNull() & partial, "warning", "period_incomplete",
                 "period", F.col("calendar_coverage_pct")),
        _finding(F.col("inferred"), "warning" if allow_inferred else "error", "period_inferred",
                 "period", number),
    ])


# --- rollup ------------------------------------------------------------------------------------

def status(all_findings: DataFrame) -> DataFrame:
    """One row: OK, WARN or BLOCKED, with the number of errors and warnings."""
    n = all_findings.agg(F.count_if(F.col("severity") == "error").alias("errors"),
                         F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.select(F.when(F.col("errors") > 0, "BLOCKED").when(F.col("warnings") > 0, "WARN")
                    .otherwise("OK").alias("status"), "errors", "warnings")


def suppress_when_blocked(result: DataFrame, one_status: DataFrame,
                          columns: Sequence[str]) -> DataFrame:
    """Null the given columns while the status is BLOCKED; rows stay."""
    gated = attach(result, one_status.select(F.col("status").alias("data_status")))
    for c in columns:
        gated = gated.withColumn(c, F.when(F.col("data_status") != "BLOCKED", F.col(c)))
    return gated
