"""Hold measures against targets, benchmarks, bands and groups."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measureloom.contract import (
    DIRECTIONS, TOTAL, Measure, Reference, Roles, Thresholds, ascii_id,
)
from measureloom.functions import calendar as cal
from measureloom.functions import cleaning
from measureloom.functions.labels import favorable
from measureloom.operators import quantiles as q
from measureloom.operators.compare import measure_attribute
from measureloom.operators.onerow import attach
from measureloom.operators.scope import CURRENT, Lock, tag
from measureloom.session import cut_lineage

SPEC_SCHEMA = (
    "id string, type string, measure_id string, unit string, value double, lower double, "
    "upper double, tolerance double, direction_rule string, field string, aggregation string, "
    "dimension string, reference_group string, required boolean, source string, "
    "invalid_reason string, parse_block_pct double")

# A target column named like one of these cannot belong to the other measure.
_QTY_NAME = (r"(?i)目标销量|销量目标|目标数量|数量目标|目标台数|台数目标|目标件数|件数目标"
             r"|\b(qty|quantity|units?)\b")
_AMOUNT_NAME = (r"(?i)目标金额|金额目标|销售额目标|营收目标|预算金额|\b(amount|revenue|gmv)\b")


def reference_frame(spark: SparkSession, refs: Sequence[Reference]) -> DataFrame:
    """Reference specifications as rows."""
    return spark.createDataFrame(
        [(r.id, r.type, r.measure, r.unit, _num(r.value), _num(r.lower), _num(r.upper),
          float(r.tolerance), r.direction_rule, r.field, r.aggregation, r.dimension,
          r.reference_group, r.required, r.source, r.invalid_reason, float(r.parse_block_pct))
         for r in refs], SPEC_SCHEMA)


def _num(value) -> float | None:
    return None if value is None else float(value)


def gather_references(scope_items: Sequence[Reference], declared: Sequence[Reference],
                      measures: Sequence[Measure], roles: Roles | None = None,
                      target_measure: str | None = None, target_aggregation: str = "auto",
                      target_grain: Sequence[str] = (), target_frequency: str = "period",
                      thresholds: Thresholds | None = None) -> list[Reference]:
    """All reference specifications of a contract in precedence order, repeated ids included.

    Sources: comparisons of the scope, declared references, a measure's own target column or
    benchmark, and the target role kept for older contracts.
    """
    refs = [replace(r, source="scope") for r in scope_items]
    refs += [replace(r, source="references") for r in declared]
    for m in measures:
        if m.target_field:
            refs.append(Reference(f"target_{m.id}", "target", m.id, m.unit, field=m.target_field,
                                  source="measure"))
        if m.benchmark is not None:
            refs.append(Reference(f"benchmark_{m.id}", "benchmark", m.id, m.unit,
                                  value=m.benchmark, source="measure"))
    column = roles.target if roles else None
    if column and not any(r.field == column and r.type == "target" for r in refs):
        refs.append(_role_target(column, roles, measures, target_measure, target_aggregation,
                                 target_grain, target_frequency, thresholds or Thresholds()))
    return [replace(r, id=ascii_id(r.id, f"reference_{i + 1}")) for i, r in enumerate(refs)]


def _role_target(column: str, roles: Roles, measures: Sequence[Measure], target: str | None,
                 aggregation: str, grain: Sequence[str], frequency: str,
                 limits: Thresholds) -> Reference:
    bound = {"amount": roles.amount, "qty": roles.qty}.get(target or "")
    measure = next((m for m in measures if m.id == target or (bound and m.field == bound)), None)
    reason = None
    if measure is None:
        reason = "legacy_target_measure_missing"
    elif (target == "amount" and re.search(_QTY_NAME, column)) or (
            target == "qty" and re.search(_AMOUNT_NAME, column)):
        reason = "legacy_target_unit_conflict"
    return Reference(
        "legacy_target", "target", measure.id if measure else (target or ""),
        measure.unit if measure else None, field=column, aggregation=aggregation,
        grain=tuple(grain), frequency=frequency, required=True, source="legacy",
        parse_block_pct=limits.target_parse_block_pct, invalid_reason=reason)


def merge_references(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of specification frames; ``duplicate`` marks ids declared more than once."""
    both = reduce(DataFrame.unionByName, frames)
    counts = both.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("duplicate"))
    return both.join(counts, "id")


def unit_status(specs: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """reference_unit_missing, reference_unit_mismatch, unknown_measure or null per reference."""
    unit = measure_attribute(measures, "unit")
    strict = F.col("source").isin("references", "measure")
    reason = (
        F.when(F.col("invalid_reason").isNotNull(), F.col("invalid_reason"))
        .when(unit.isNull(), "unknown_measure")
        .when(strict & (F.coalesce("unit", F.lit("")) == ""), "reference_unit_missing")
        .when(F.col("unit").isNotNull() & (F.col("unit") != unit), "reference_unit_mismatch"))
    return specs.withColumn("unit_reason", reason)


_PER_GROUP = ("first_per_group", "unique_per_period")
_SIMPLE = {"unique": F.min, "auto": F.min, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
_RESOLVED = ("id string, field_value double, reason_code string, parse_errors bigint, "
             "parse_error_pct double")


def _declaration_problem(ref: Reference, columns: Sequence[str], time: str | None) -> str | None:
    """Reason code when a column reference cannot be resolved whatever the data is."""
    if not ref.field or ref.field not in columns:
        return "optional_reference_field_missing"
    if ref.aggregation in _PER_GROUP:
        if any(g not in columns for g in _grain(ref)):
            return "reference_grain_missing"
        if ref.frequency not in cal.FREQUENCIES:
            return "reference_frequency_invalid"
        if ref.frequency != "period" and time is None:
            return "reference_frequency_requires_time"
    elif ref.aggregation not in (*_SIMPLE, "median"):
        return "reference_aggregation_invalid"
    return None


def _grain(ref: Reference) -> list[str]:
    return list(ref.grain) if ref.aggregation == "first_per_group" else []


def _resolved(ref: Reference, value: Column, reason: Column, bad: Column, filled: Column) -> Column:
    share = F.coalesce(bad / F.when(filled > 0, filled) * 100, F.lit(0.0))
    return F.struct(
        F.lit(ref.id).alias("id"), F.when(reason.isNull(), value).alias("field_value"),
        reason.alias("reason_code"), F.coalesce(bad, F.lit(0)).cast("bigint").alias("parse_errors"),
        share.alias("parse_error_pct"))


def _shared_values(rows: DataFrame, refs: Sequence[Reference], day: Column | None) -> DataFrame:
    """All references from one aggregate of the rows; medians that its buckets leave open from a second.

    Every row counts once for all plain aggregates (mark 0), and once for each reference that needs
    groups of its own: the period and grain of a deduplicated one, the bucket of the value of a median.
    """
    fields = {f: k for k, f in enumerate(dict.fromkeys(r.field for r in refs))}
    simple = [r for r in refs if r.aggregation in _SIMPLE]
    marks = {i: r for i, r in enumerate(refs, 1) if r.aggregation not in _SIMPLE}
    keys = {}
    for i, ref in marks.items():
        if ref.aggregation == "median":
            keys[i] = None
            continue
        period = F.lit(cal.WHOLE_PERIOD) if ref.frequency == "period" else cal.period_key(day, ref.frequency)
        keys[i] = F.array(period, *[cleaning.member(F.col(f"`{g}`")) for g in _grain(ref)])
    flat = rows.select(
        *[cleaning.number(rows, f).alias(f"_f{k}") for f, k in fields.items()],
        *[F.col(f"`{f}`").isNotNull().alias(f"_p{k}") for f, k in fields.items()],
        *[key.alias(f"_key{i}") for i, key in keys.items() if key is not None])

    def entry(i: int, field: str | None, key: Column) -> Column:
        value, there = (F.lit(None), F.lit(False)) if field is None else (F.col(f"_f{fields[field]}"), F.col(f"_p{fields[field]}"))
        return F.struct(F.lit(i).alias("mark"), key.cast("array<string>").alias("key"), value.cast("double").alias("v"),
                        there.alias("there"))

    def bucket_key(i: int) -> Column:
        return F.array(q.bucket(F.col(f"_f{fields[marks[i].field]}") + F.lit(0.0)).cast("string"))

    entries = [entry(0, None, F.array())] + [
        entry(i, r.field, F.col(f"_key{i}") if keys[i] is not None else bucket_key(i)) for i, r in marks.items()]
    apart = flat.withColumn("_m", F.explode(F.array(*entries)))
    aggs = []
    for j, r in enumerate(simple):
        first = F.col("_m.mark") == 0
        value, there = F.when(first, F.col(f"_f{fields[r.field]}")), first & F.col(f"_p{fields[r.field]}")
        aggs += [F.count_if(there).alias(f"f{j}"), F.count_if(there & value.isNull()).alias(f"b{j}"), F.count(value).alias(f"n{j}"),
                 _SIMPLE[r.aggregation](value).alias(f"v{j}"), F.max(value).alias(f"h{j}")]
    v, there = F.col("_m.v"), F.col("_m.there")
    counters = cut_lineage(apart.groupBy(F.col("_m.mark").alias("_mark"), F.col("_m.key").alias("_key")).agg(
        *aggs, F.count_if(there).alias("f"), F.count_if(there & v.isNull()).alias("b"), F.count(v).alias("_n"),
        F.min(v).alias("_low"), F.max(v).alias("_high")))

    def of(i: int, c: str | Column) -> Column:
        return F.when(F.col("_mark") == i, F.col(c) if isinstance(c, str) else c)

    whole = [F.max(of(0, f"{c}{j}")).alias(f"{c}{j}") for j in range(len(simple)) for c in "fbnvh"]
    for i, r in marks.items():
        low, high = F.col("_low"), F.col("_high")
        whole += [F.sum(of(i, "f")).alias(f"f_{i}"), F.sum(of(i, "b")).alias(f"b_{i}"), F.sum(of(i, "_n")).alias(f"n_{i}"),
                  F.count_if((F.col("_mark") == i) & low.isNull()).alias(f"empty_{i}"),
                  F.count_if((F.col("_mark") == i) & (low != high)).alias(f"torn_{i}"), F.sum(of(i, low)).alias(f"v_{i}")]
    one = counters.agg(*whole)
    medians = [i for i in marks if keys[i] is None]
    if medians:
        buckets = counters.where(F.col("_mark").isin(medians) & (F.col("_n") > 0)).select(
            "_mark", F.col("_key")[0].cast("int").alias("_b"), "_n", "_low", "_high")
        values = apart.where(F.col("_m.mark").isin(medians) & v.isNotNull()).select(
            F.col("_m.mark").alias("_mark"), F.col("_m.key")[0].cast("int").alias("_b"), (v + F.lit(0.0)).alias("_v"))
        middle = q.values_at(buckets, values, ["_mark"], {"middle": 0.5})
        one = attach(one, middle.agg(*[F.max(of(i, "middle")).alias(f"middle_{i}") for i in medians]))

    resolved = []
    for j, r in enumerate(simple):
        n, value = F.coalesce(f"n{j}", F.lit(0)), F.col(f"v{j}")
        accepted = {"auto": n == 1, "unique": value == F.col(f"h{j}")}.get(r.aggregation, F.lit(True))
        reason = F.when(n == 0, "reference_missing").when(
            ~accepted, "reference_field_requires_single_value_or_explicit_aggregation")
        resolved.append(_resolved(r, value, reason, F.col(f"b{j}"), F.col(f"f{j}")))
    for i, r in marks.items():
        reason = F.when(F.coalesce(f"n_{i}", F.lit(0)) == 0, "reference_missing")
        if keys[i] is not None:
            reason = reason.when(F.col(f"empty_{i}") > 0, "reference_grain_incomplete").when(
                F.col(f"torn_{i}") > 0, "reference_grain_conflict")
        resolved.append(_resolved(r, F.col(f"v_{i}" if keys[i] is not None else f"middle_{i}"), reason, F.col(f"b_{i}"), F.col(f"f_{i}")))
    return one.select(F.explode(F.array(*resolved)).alias("r")).select("r.*")


def field_references(df: DataFrame, refs: Sequence[Reference], lock: Lock, time: str | None,
                     timezone: str | None = None) -> DataFrame:
    """Resolve every reference that reads a column to one value over the current period.

    Columns: id, field_value, reason_code, parse_errors, parse_error_pct. All references share one
    scan, whose counters are made when this is called; medians may take a second.
    """
    spark = df.sparkSession
    needed = [r for r in refs if r.type != "group" and r.value is None
              and (r.lower is None or r.upper is None)]
    problems = {r.id: _declaration_problem(r, df.columns, time) for r in needed}
    rows = tag(df, lock, time, timezone).where(F.col(CURRENT))
    day = F.to_date(cleaning.timestamp(rows, time, timezone)) if time is not None else None
    frames = [spark.createDataFrame(
        [(i, None, reason, 0, 0.0) for i, reason in problems.items() if reason], _RESOLVED)]
    usable = [r for r in needed if not problems[r.id]]
    if usable:
        frames.append(_shared_values(rows, usable, day))
    return reduce(DataFrame.unionByName, frames)


def evaluate_references(refs: Sequence[Reference], totals: DataFrame, measures: Sequence[Measure],
                        fields: DataFrame | None = None) -> DataFrame:
    """Targets, benchmarks and bands against the totals of their measures.

    ``totals`` has measure_id and current. One row per reference with status and reason.
    """
    spark = totals.sparkSession
    specs = unit_status(reference_frame(spark, refs).where(F.col("type") != "group"), measures)
    if fields is not None:
        specs = specs.join(fields, "id", "left")
    else:
        specs = specs.select(
            "*", F.lit(None).cast("double").alias("field_value"),
            F.lit(None).cast("string").alias("reason_code"),
            F.lit(0.0).alias("parse_error_pct"))
    joined = specs.join(totals.select("measure_id", "current"), "measure_id", "left")
    rule = F.coalesce("direction_rule", measure_attribute(measures, "direction"))
    reference = F.coalesce("value", "field_value")
    current, tolerance = F.col("current"), F.col("tolerance")
    half_band = F.col("lower").isNotNull() | F.col("upper").isNotNull()
    full_band = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    bad_band = half_band & (~full_band | (F.col("lower") > F.col("upper")))
    reason = (
        F.when(F.col("unit_reason").isNotNull(), F.col("unit_reason"))
        .when(current.isNull(), "measure_current_unavailable")
        .when(F.coalesce("parse_error_pct", F.lit(0.0)) > F.col("parse_block_pct"),
              "reference_parse_error_above_threshold")
        .when(bad_band, "reference_contract_invalid")
        .when(full_band, F.lit(None).cast("string"))
        .when(reference.isNull(), F.coalesce("reason_code", F.lit("reference_missing")))
        .when((F.col("source") == "legacy") & (reference <= 0), "reference_contract_invalid")
        .when(~rule.isin(*DIRECTIONS, "closer_to_target"), "reference_contract_invalid"))
    ok = F.col("final_reason").isNull()
    band = ok & full_band
    inside = (current >= F.col("lower") - tolerance) & (current <= F.col("upper") + tolerance)
    delta = current - reference
    outside = F.least(F.abs(current - F.col("lower")), F.abs(current - F.col("upper")))
    attained = (F.when(rule == "lower_is_better", reference / F.when(current > 0, current))
                .otherwise(current / F.when(reference > 0, reference)) * 100)
    verdict = F.when(rule == "closer_to_target", F.abs(delta) <= tolerance).otherwise(
        favorable(delta, rule))
    shown = joined.withColumn("final_reason", reason)
    return shown.select(
        "id", "type", "measure_id",
        F.when(ok, "OK").when(F.col("required"), "BLOCKED").otherwise("SKIPPED").alias("status"),
        F.col("final_reason").alias("reason_code"),
        F.when(ok, current).alias("current"),
        F.when(ok & ~full_band, reference).alias("reference"),
        F.when(band, F.col("lower")).alias("lower"), F.when(band, F.col("upper")).alias("upper"),
        F.when(band, F.when(inside, 0.0).otherwise(outside)).when(ok, delta).alias("delta"),
        F.when(ok & ~full_band & (current > 0) & (reference > 0), attained)
        .alias("attainment_rate"),
        F.when(band, inside).when(ok, verdict).alias("favorable"))


def group_references(refs: Sequence[Reference], facts: DataFrame,
                     measures: Sequence[Measure]) -> DataFrame:
    """Every member against a named member, or against the total when none is named.

    References whose dimension or member does not exist give no rows.
    """
    spark = facts.sparkSession
    specs = unit_status(reference_frame(spark, [r for r in refs if r.type == "group"]), measures)
    specs = specs.where(F.col("unit_reason").isNull()).select(
        "id", "measure_id", "dimension", "reference_group")
    mine = facts.select("measure_id", "dimension", "name", "current")
    overall = F.col("reference_group").isNull()
    wanted = specs.select(
        "*", F.when(overall, TOTAL).otherwise(F.col("dimension")).alias("_d"),
        F.when(overall, TOTAL).otherwise(F.col("reference_group")).alias("_n"))
    # Specifications are declared by hand, and each finds one anchor row: both are safe to broadcast.
    anchors = mine.select(
        "measure_id", F.col("dimension").alias("_d"), F.col("name").alias("_n"),
        F.col("current").alias("reference")).join(
        F.broadcast(wanted), ["measure_id", "_d", "_n"]).drop("_d", "_n")
    delta = F.col("current") - F.col("reference")
    return mine.join(F.broadcast(anchors), ["measure_id", "dimension"]).select(
        "id", "measure_id", "dimension",
        F.coalesce("reference_group", F.lit("overall")).alias("reference_group"), "name",
        "current", "reference", delta.alias("delta"),
        favorable(delta, measure_attribute(measures, "direction")).alias("favorable"))


def legacy_target(records: DataFrame) -> DataFrame:
    """The older target projection: actual, plan, achievement and gap of the role target."""
    return records.where(F.col("id") == "legacy_target").select(
        "measure_id", "status", F.col("current").alias("actual"), F.col("reference").alias("plan"),
        F.col("attainment_rate").alias("achievement_rate"), F.col("delta").alias("gap"))


