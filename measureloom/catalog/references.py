"""I: targets, benchmarks, bands and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from measureloom.catalog.comparisons import facts
from measureloom.catalog.registry import (
    CONTRACT, QUANTITY, RETURNS, REVENUE, SALES, TIME, facts_sql, lock_of, query, r4, sales,
)
from measureloom.contract import Reference, Roles
from measureloom.operators import compare as c
from measureloom.operators import references as ref

_CUR = "o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'"
_IDS = [m.id for m in CONTRACT]
_TOTALS = f"""{SALES}, {facts_sql(_IDS, ['segment'])},
t AS (SELECT measure_id, current FROM facts WHERE dimension = '(total)')"""


def _totals(spark, d):
    return c.total_comparison(facts(spark, d, CONTRACT, ("segment",)), CONTRACT)


_SCALAR = (
    Reference("revenue_plan", "target", "revenue", "currency", value=2.0e8),
    Reference("revenue_stretch", "target", "revenue", "currency", value=9.0e12),
    Reference("return_benchmark", "benchmark", "return_pct", "percent", value=30.0),
    Reference("return_ceiling", "benchmark", "return_pct", "percent", value=40.0),
)


def _scalar_sql(rows: str) -> str:
    return f"""WITH {_TOTALS}, r(id, measure_id, ref) AS (VALUES {rows}),
v AS (SELECT id, measure_id, ref, current, current - ref AS delta,
  CASE WHEN measure_id = 'return_pct' THEN ref / current ELSE current / ref END * 100 AS att,
  measure_id = 'return_pct' AS lower_better FROM r JOIN t USING (measure_id))"""


@query("i01_scalar_references", _scalar_sql(
    "('revenue_plan', 'revenue', 2.0e8), ('revenue_stretch', 'revenue', 9.0e12), "
    "('return_benchmark', 'return_pct', 30.0), ('return_ceiling', 'return_pct', 40.0)")
    + f""" SELECT id, measure_id, 'OK' AS status, {r4('current')} AS current,
  {r4('ref::DOUBLE')} AS reference, {r4('delta')} AS delta, {r4('att')} AS attainment_rate,
  CASE WHEN lower_better THEN delta <= 0 ELSE delta >= 0 END AS favorable FROM v""")
def i01(spark, d):
    return ref.evaluate_references(_SCALAR, _totals(spark, d), CONTRACT).select(
        "id", "measure_id", "status", "current", "reference", "delta", "attainment_rate",
        "favorable")


@query("i02_closer_to_target", _scalar_sql(
    "('near', 'return_pct', 33.0), ('far', 'return_pct', 50.0)")
    + f" SELECT id, {r4('delta')} AS delta, abs(delta) <= 5 AS favorable FROM v")
def i02(spark, d):
    refs = [Reference(i, "target", "return_pct", "percent", value=v, tolerance=5.0,
                      direction_rule="closer_to_target") for i, v in (("near", 33.0), ("far", 50.0))]
    return ref.evaluate_references(refs, _totals(spark, d), CONTRACT).select(
        "id", "delta", "favorable")


@query("i03_range_band", f"""WITH {_TOTALS}, r(id, lo, hi, tol) AS (VALUES ('inside', 20.0, 60.0, 0.0),
  ('outside', 50.0, 60.0, 0.5), ('tolerated', 50.0, 60.0, 40.0), ('broken', 60.0, 50.0, 0.0))
SELECT id, CASE WHEN lo <= hi THEN 'OK' ELSE 'SKIPPED' END AS status,
  CASE WHEN lo > hi THEN 'reference_contract_invalid' END AS reason_code,
  {r4('CASE WHEN lo <= hi THEN lo END::DOUBLE')} AS lower,
  {r4('CASE WHEN lo <= hi THEN hi END::DOUBLE')} AS upper,
  {r4('''CASE WHEN lo <= hi THEN CASE WHEN current BETWEEN lo - tol AND hi + tol THEN 0
    ELSE least(abs(current - lo), abs(current - hi)) END END''')} AS delta,
  CASE WHEN lo <= hi THEN current BETWEEN lo - tol AND hi + tol END AS favorable
FROM r, t WHERE measure_id = 'return_pct'""")
def i03(spark, d):
    bands = (("inside", 20.0, 60.0, 0.0), ("outside", 50.0, 60.0, 0.5),
             ("tolerated", 50.0, 60.0, 40.0), ("broken", 60.0, 50.0, 0.0))
    refs = [Reference(i, "benchmark", "return_pct", "percent", lower=lo, upper=hi, tolerance=tol)
            for i, lo, hi, tol in bands]
    return ref.evaluate_references(refs, _totals(spark, d), CONTRACT).select(
        "id", "status", "reason_code", "lower", "upper", "delta", "favorable")


@query("i04_group_references", f"""WITH {_TOTALS}, s AS (SELECT measure_id, name, current FROM facts
  WHERE dimension = 'segment'),
a AS (SELECT 'revenue_vs_building' AS id, 'revenue' AS measure_id, 'BUILDING' AS reference_group,
    current AS reference FROM s WHERE measure_id = 'revenue' AND name = 'BUILDING'
  UNION ALL SELECT 'returns_vs_overall', 'return_pct', 'overall', current FROM t
  WHERE measure_id = 'return_pct')
SELECT id, reference_group, name, {r4('current')} AS current, {r4('reference')} AS reference,
  {r4('current - reference')} AS delta,
  CASE WHEN measure_id = 'revenue' THEN current >= reference ELSE current <= reference END
    AS favorable FROM a JOIN s USING (measure_id)""")
def i04(spark, d):
    refs = [Reference("revenue_vs_building", "group", "revenue", "currency", dimension="segment",
                      reference_group="BUILDING"),
            Reference("returns_vs_overall", "group", "return_pct", "percent", dimension="segment"),
            Reference("nobody", "group", "revenue", "currency", dimension="segment",
                      reference_group="NOBODY")]
    return ref.group_references(refs, facts(spark, d, CONTRACT, ("segment",)), CONTRACT).select(
        "id", "reference_group", "name", "current", "reference", "delta", "favorable")


def _planned(spark, d):
    """Sales with plan columns derived from the data itself."""
    customer = F.col("customer").cast("double")
    return sales(spark, d).select(
        "*", F.lit(1000.0).alias("flat_plan"), (F.col("list_price") * 2).alias("line_plan"),
        (F.length("region") * 1000.0 + F.quarter(TIME)).alias("zone_plan"),
        F.when(F.col("region") != "ASIA", F.lit(5.0)).alias("gappy_plan"),
        F.when(F.col("flag") == "A", F.lit("n/a")).otherwise(
            F.col("list_price").cast("string")).alias("text_plan"),
        customer.alias("torn_plan"))


def _resolved(spark, d, *refs):
    df = _planned(spark, d)
    return ref.field_references(df, refs, lock_of(df), TIME).select(
        "id", "field_value", "reason_code", "parse_errors", "parse_error_pct")


def _target(name, field, how, **more):
    return Reference(name, "target", "revenue", "currency", field=field, aggregation=how, **more)


def _plan_row(name: str, value: str = "NULL::DOUBLE", reason: str = "NULL::VARCHAR",
              errors: str = "0::BIGINT", pct: str = "0.0::DOUBLE", where: str = "true") -> str:
    return (f"SELECT '{name}' AS id, {r4(value)} AS field_value, {reason} AS reason_code, "
            f"{errors} AS parse_errors, {r4(pct)} AS parse_error_pct FROM sales "
            f"WHERE {_CUR} AND {where}")


_NEEDS_ONE = "'reference_field_requires_single_value_or_explicit_aggregation'"


@query("i05_unique_field_reference", f"WITH {SALES} " + " UNION ALL ".join((
    _plan_row("flat", "CASE WHEN count(*) > 0 THEN 1000.0 END"),
    _plan_row("flat_auto", reason=f"CASE WHEN count(*) > 1 THEN {_NEEDS_ONE} END"),
    _plan_row("torn", reason=f"CASE WHEN count(DISTINCT customer) > 1 THEN {_NEEDS_ONE} END"),
    _plan_row("absent", reason="CASE WHEN count(*) > 0 THEN 'optional_reference_field_missing' END"))))
def i05(spark, d):
    return _resolved(spark, d, _target("flat", "flat_plan", "unique"),
                     _target("flat_auto", "flat_plan", "auto"),
                     _target("torn", "torn_plan", "unique"), _target("absent", "no_plan", "unique"))


@query("i06_aggregated_field_reference", f"WITH {SALES} " + " UNION ALL ".join(
    _plan_row(f"plan_{how}", f"{sql}(list_price * 2)")
    for how, sql in (("sum", "sum"), ("mean", "avg"), ("median", "median"), ("min", "min"),
                     ("max", "max"))))
def i06(spark, d):
    return _resolved(spark, d, *[_target(f"plan_{how}", "line_plan", how)
                                 for how in ("sum", "mean", "median", "min", "max")])


@query("i07_deduplicated_field_reference", f"""WITH {SALES}, k AS (SELECT DISTINCT region,
  quarter(o_orderdate) AS q FROM sales WHERE {_CUR})
SELECT 'per_zone_quarter' AS id, {r4('sum(length(region) * 1000.0 + q)')} AS field_value,
  NULL::VARCHAR AS reason_code FROM k
UNION ALL SELECT id, NULL, reason FROM (VALUES ('per_zone', 'reference_grain_conflict'),
  ('per_quarter', 'reference_grain_conflict'), ('gappy', 'reference_grain_incomplete'),
  ('no_grain', 'reference_grain_missing')) v(id, reason)
WHERE (SELECT count(*) FROM k) > 0""")
def i07(spark, d):
    return _resolved(
        spark, d,
        _target("per_zone_quarter", "zone_plan", "first_per_group", grain=("region",),
                frequency="quarter"),
        _target("per_zone", "zone_plan", "first_per_group", grain=("region",)),
        _target("per_quarter", "zone_plan", "unique_per_period", frequency="quarter"),
        _target("gappy", "gappy_plan", "first_per_group", grain=("region",)),
        _target("no_grain", "zone_plan", "first_per_group", grain=("county",))
    ).select("id", "field_value", "reason_code")


@query("i08_reference_parse_errors", f"""WITH {_TOTALS}, q AS (SELECT
    sum(list_price) FILTER (WHERE flag <> 'A') AS plan, count(*) FILTER (WHERE flag = 'A') AS bad,
    100.0 * count(*) FILTER (WHERE flag = 'A') / count(*) AS pct FROM scoped WHERE cur),
r(id, lim) AS (VALUES ('strict', 5.0), ('lenient', 100.0))
SELECT id, CASE WHEN pct > lim THEN 'BLOCKED' ELSE 'OK' END AS status,
  CASE WHEN pct > lim THEN 'reference_parse_error_above_threshold' END AS reason_code,
  {r4('CASE WHEN pct <= lim THEN plan END')} AS reference,
  {r4('CASE WHEN pct <= lim THEN current / plan * 100 END')} AS attainment_rate
FROM r, q, t WHERE measure_id = 'revenue'""")
def i08(spark, d):
    df = _planned(spark, d)
    refs = [_target(i, "text_plan", "sum", required=True, parse_block_pct=limit)
            for i, limit in (("strict", 5.0), ("lenient", 100.0))]
    resolved = ref.field_references(df, refs, lock_of(df), TIME)
    return ref.evaluate_references(refs, _totals(spark, d), CONTRACT, resolved).select(
        "id", "status", "reason_code", "reference", "attainment_rate")


@query("i09_unit_match", f"""WITH {_TOTALS} SELECT r.id, CASE WHEN reason IS NULL THEN 'OK'
    ELSE 'SKIPPED' END AS status, reason AS reason_code,
  {r4('CASE WHEN reason IS NULL THEN current END')} AS current
FROM (VALUES ('same', 'revenue', NULL), ('other', 'revenue', 'reference_unit_mismatch'),
  ('none', 'revenue', 'reference_unit_missing'), ('ghost', 'ghost', 'unknown_measure'))
  r(id, measure_id, reason) LEFT JOIN t USING (measure_id)""")
def i09(spark, d):
    refs = [Reference("same", "target", "revenue", "currency", value=1.0),
            Reference("other", "target", "revenue", "count", value=1.0),
            Reference("none", "target", "revenue", None, value=1.0),
            Reference("ghost", "target", "ghost", "currency", value=1.0)]
    return ref.evaluate_references(refs, _totals(spark, d), CONTRACT).select(
        "id", "status", "reason_code", "current")


@query("i10_merged_references", f"""WITH {_TOTALS} SELECT r.id, source, duplicate,
  {r4('current')} AS current FROM (VALUES ('plan', 'scope', 'revenue', true),
  ('plan', 'references', 'revenue', true), ('target_quantity', 'measure', 'quantity', false),
  ('benchmark_return_pct', 'measure', 'return_pct', false),
  ('legacy_target', 'legacy', 'revenue', false)) r(id, source, measure_id, duplicate)
JOIN t USING (measure_id)""")
def i10(spark, d):
    from dataclasses import replace

    measures = [REVENUE, replace(QUANTITY, target_field="flat_plan"),
                replace(RETURNS, benchmark=30.0)]
    roles = Roles(time=TIME, target="zone_plan", amount="revenue", qty="quantity")
    gathered = ref.gather_references(
        [Reference("plan", "target", "revenue", "currency", value=1.0)],
        [Reference("Plan", "target", "revenue", "currency", value=2.0)], measures, roles,
        target_measure="amount")
    specs = ref.merge_references([ref.reference_frame(spark, gathered)])
    return specs.join(_totals(spark, d), "measure_id").select(
        "id", "source", "duplicate", "current")


@query("i10_legacy_target_projection", f"""WITH {_TOTALS}, p AS (
  SELECT sum(length(region) * 1000.0 + q) AS plan FROM (SELECT DISTINCT region,
    quarter(o_orderdate) AS q FROM sales WHERE {_CUR}))
SELECT measure_id, 'OK' AS status, {r4('current')} AS actual, {r4('plan')} AS plan,
  {r4('current / plan * 100')} AS achievement_rate, {r4('current - plan')} AS gap
FROM t, p WHERE measure_id = 'revenue'""")
def i10_legacy(spark, d):
    df = _planned(spark, d)
    roles = Roles(time=TIME, target="zone_plan", amount="revenue", qty="quantity")
    refs = ref.gather_references([], [], CONTRACT, roles, "amount", "first_per_group", ["region"],
                                 "quarter")
    resolved = ref.field_references(df, refs, lock_of(df), TIME)
    return ref.legacy_target(
        ref.evaluate_references(refs, _totals(spark, d), CONTRACT, resolved))
