"""From a table and its contract to gated results.

Scans of the table: one for the row-level gates of the scope, one for duplicates, one for the
member facts (all measures, dimensions and both sides together), one for the monthly series, and
one each for the optional parts (fingerprint, declared schema). The facts are written once; every
result after that reads the written copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measureloom.contract import (
    Measure, Reference, Roles, SchemaContract, Scope, Thresholds, check_measures, primary_of,
)
from measureloom.operators import aggregate, compare, lineage, quality, references, scope, shape
from measureloom.operators import statistics as stats
from measureloom.session import cut_lineage, written_table
from measureloom.sources.sinks import write_findings, write_metrics


@dataclass(frozen=True)
class Contract:
    """Everything declared about a table."""

    measures: Sequence[Measure]
    roles: Roles = Roles()
    scope: Scope = Scope(mode="snapshot")
    schema: SchemaContract | None = None
    thresholds: Thresholds = Thresholds()
    references: Sequence[Reference] = ()
    scope_references: Sequence[Reference] = ()
    target_measure: str | None = None
    target_aggregation: str = "auto"
    target_grain: Sequence[str] = ()
    target_frequency: str = "period"
    expected_observations: tuple[str, int, int] | None = None  # mode, current, base


@dataclass(frozen=True)
class Report:
    """Lazy results of one run. ``values`` frames are null while the run is BLOCKED."""

    contract: Contract
    measures: Sequence[Measure]
    lock: scope.Lock
    findings: DataFrame
    status: DataFrame
    facts: DataFrame
    totals: DataFrame
    rows: DataFrame
    references: DataFrame
    groups: DataFrame
    methods: DataFrame
    lock_row: DataFrame | None = None
    series: DataFrame | None = None
    matrix: DataFrame | None = None
    pvm: DataFrame | None = None
    concentration: DataFrame | None = None
    snapshot: DataFrame | None = None
    drift: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)
    make_distribution: Callable[[], DataFrame] | None = None

    @cached_property
    def distribution(self) -> DataFrame:
        """Quantiles of the row values; their counters are only made when this is first read."""
        return self.make_distribution()


_VALUES = ["current", "baseline"]


def build_report(df: DataFrame, contract: Contract, baseline: DataFrame | None = None,
                 fingerprint: bool = False, expected_change: bool | None = None,
                 allow_schema_change: bool = False,
                 allow_semantic_change: bool = False, write_once: bool = False) -> Report:
    """Run the whole contract. ``baseline`` is the snapshot row of an earlier run, if any.

    A report reads its input about nine times. With ``write_once`` the input is written to a table
    in the checkpoint folder first and read from there, which pays when it is more than a plain scan.
    """
    if write_once:
        df = written_table(df)
    spark, roles, limits = df.sparkSession, contract.roles, contract.thresholds
    time = roles.time if roles.time in df.columns else None
    timezone = contract.scope.timezone
    measures, problems = check_measures(contract.measures, df.columns, time is not None)
    if not measures:
        raise ValueError(f"no usable measure: {problems}")
    primary = primary_of(measures)
    period = contract.scope.mode == "period" and time is not None
    lock = scope.resolve(df, contract.scope, time if period else None)
    lock_row = None
    found = [quality.findings(spark, [(*p, None, None) for p in problems]),
             quality.empty_source(df), quality.missing_roles(df, roles)]
    if contract.scope.mode == "period" and time is None:
        found.append(quality.findings(
            spark, [("error", "period_without_time_column", str(roles.time), None, None)]))
    if period:
        lock_row = scope.lock_row(df, contract.scope, time)
        found += [quality.time_gates(df, time, timezone, limits),
                  quality.cutoff_gate(lock_row, contract.scope.allow_inferred_period)]
    if contract.schema is not None:
        found += _schema_findings(df, contract, measures)
    elif roles.amount and roles.amount == roles.qty:
        found.append(quality.contract_conflicts(spark, SchemaContract(), measures, roles, False))
    if roles.id in df.columns:
        found.append(quality.repeated_ids(df, roles.id))

    empty_scope = period and scope.tag(df, lock, time, timezone).isEmpty()
    counts = cut_lineage(quality.scope_counts(df, primary, lock, time, timezone,
                                              judge_all=empty_scope))
    found += [quality.measure_gates(counts, primary, limits),
              quality.duplicate_gate(
                  quality.duplicate_rows(df, primary, lock, time, timezone), limits),
              quality.axis_gate(
                  quality.axis_quality(df, measures, lock, time, timezone), measures)]
    if period:
        found.append(quality.empty_current(counts))
    if contract.expected_observations and period:
        mode, expected_current, expected_base = contract.expected_observations
        found.append(quality.observation_gate(counts, expected_current, expected_base, mode, limits))

    dims = [d for d in dict.fromkeys(
        [*roles.dimensions, roles.product, roles.customer]) if d in df.columns]
    series = None
    if period:
        facts, series = aggregate.facts_and_series(
            df, measures, dims, lock, time, timezone, cheap=write_once)
        facts = cut_lineage(facts)
    else:
        facts = cut_lineage(aggregate.member_facts(df, measures, dims, lock, time, timezone, write_once=True))
    raw_totals = compare.total_comparison(facts, measures)
    if period:
        found.append(quality.baseline_gate(counts, raw_totals, primary, lock))

    # Values are withheld by what is known up to here; later findings only mark the run.
    early = cut_lineage(quality.union(found))
    gate = quality.status(early)
    totals = compare.total_comparison(
        quality.suppress_when_blocked(facts, gate, _VALUES), measures)
    open_facts = cut_lineage(quality.suppress_when_blocked(facts, gate, _VALUES))
    rows = compare.member_comparison(open_facts, measures)
    declared = rows.where(F.col("dimension").isin(*roles.dimensions)) if roles.dimensions else (
        rows.where(F.lit(False)))
    late = [quality.share_sum_gate(declared.where(F.col("measure_id") == primary.id)),
            quality.weak_dimensions(declared.where(F.col("measure_id") == primary.id))]
    if lock.has_base and roles.dimensions:
        late.append(quality.member_drift(
            facts.where(F.col("dimension").isin(*roles.dimensions)), limits))

    snapshot = drift = None
    if fingerprint or baseline is not None:
        snapshot = cut_lineage(lineage.snapshot(df, measures, contract.schema))
    if baseline is not None:
        drift = lineage.drift(snapshot, baseline, allow_schema=allow_schema_change,
                              allow_semantic=allow_semantic_change,
                              expected_change=expected_change)
        late.append(lineage.drift_findings(drift))

    refs = references.gather_references(
        contract.scope_references, contract.references, measures, roles, contract.target_measure,
        contract.target_aggregation, contract.target_grain, contract.target_frequency, limits)
    repeated = {r.id for i, r in enumerate(refs) if r.id in {x.id for x in refs[:i]}}
    late.append(quality.findings(
        spark, [("error", "reference_id_repeated", i, None, None) for i in sorted(repeated)]))
    refs = list({r.id: r for r in reversed(refs)}.values())[::-1]
    fields = references.field_references(df, refs, lock, time, timezone)
    records = references.evaluate_references(refs, totals, measures, fields)
    late.append(records.where(F.col("status") == "BLOCKED").select(
        F.lit("warning").alias("severity"), F.lit("reference_blocked").alias("code"),
        F.concat_ws(": ", "id", "reason_code").alias("subject"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold")))
    findings = quality.union([early, *late])

    matrix = pvm = concentration = None
    if period:
        if lock.comparison_type == "year_over_year":
            matrix = aggregate.year_month_matrix(df, primary, lock, time, timezone)
        volume = next((m for m in measures if m.semantic_type == "quantity"
                       and m.aggregation == "sum" and m.additivity == "additive"
                       and m.field != primary.field), None)
        if volume and lock.has_base and (primary.semantic_type, primary.aggregation) == (
                "amount", "sum"):
            pvm = compare.price_volume_mix(df, primary, volume, lock, time, limits, timezone)
    if roles.customer in dims:
        concentration = shape.concentration(open_facts, primary, roles.customer, limits)
    return Report(
        contract, measures, lock, findings, quality.status(findings), facts, totals, rows, records,
        references.group_references(refs, open_facts, measures),
        stats.method_applicability(declared, series, pvm, measures, not period),
        lock_row, series, matrix, pvm, concentration, snapshot, drift,
        make_distribution=lambda: aggregate.distribution(df, measures, lock, time, timezone))


def _schema_findings(df: DataFrame, contract: Contract,
                     measures: Sequence[Measure]) -> list[DataFrame]:
    declared = contract.schema
    out = [quality.contract_conflicts(df.sparkSession, declared, measures, contract.roles),
           quality.observed_units(df, measures), quality.key_duplicates(df, declared)]
    if declared.fields:
        out += [quality.missing_fields(df, declared), quality.type_drift(df, declared)]
    return out


def save_report(report: Report, folder: str, fmt: str = "parquet") -> None:
    """Write every result as a table of its own and the findings as text as well."""
    for name in ("findings", "status", "totals", "rows", "distribution", "references", "groups",
                 "methods", "lock_row", "series", "matrix", "pvm", "concentration", "snapshot",
                 "drift"):
        frame = getattr(report, name)
        if frame is not None:
            write_metrics(frame, f"{folder}/{name}", fmt)
    write_findings(report.findings, f"{folder}/findings_text")
