"""Declared configuration: what a measure means, which columns play which role, what is compared.

These are plain frozen dataclasses. They never hold data; operators read them on the driver to
build a DataFrame plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

# The vocabulary of the measure contract.
AGGREGATIONS = (
    "sum", "mean", "weighted_mean", "median", "min", "max", "count", "distinct_count", "ratio",
)
TIME_AGGREGATIONS = ("sum", "mean", "median", "min", "max", "ending", "last_non_null")
DIRECTIONS = ("higher_is_better", "lower_is_better", "neutral")
ADDITIVITY = ("additive", "semi_additive", "non_additive")
SEMANTIC_TYPES = (
    "amount", "quantity", "count", "people", "duration", "score", "rate", "percentage",
    "inventory", "defect_rate", "price", "other",
)
STORAGE_SCALES = ("raw", "fraction", "percent")
PERCENT_TYPES = ("rate", "percentage", "defect_rate")
NUMERIC_FIELD_TYPES = ("number", "numeric", "float", "integer", "int")
TIME_FIELD_TYPES = ("date", "datetime", "time")

# Accepted spellings of a comparison and the comparison each one means.
COMPARISONS = {
    "yoy": "year_over_year",
    "year_over_year": "year_over_year",
    "mom": "previous_calendar_period",
    "qoq": "previous_calendar_period",
    "wow": "previous_calendar_period",
    "previous_calendar_period": "previous_calendar_period",
    "previous_complete_period": "previous_complete_period",
    "period_over_period": "period_over_period",
    "previous_period": "period_over_period",
    "previous_equal_window": "previous_equal_window",
    "rolling_previous_window": "previous_equal_window",
    "same_stage_previous_period": "same_stage_previous_period",
    "same_stage": "same_stage_previous_period",
    "custom": "custom",
    "target": "target",
    "benchmark": "benchmark",
    "group": "group",
    "none": "none",
}
TIME_COMPARISONS = (
    "year_over_year", "period_over_period", "previous_equal_window", "previous_calendar_period",
    "previous_complete_period", "same_stage_previous_period", "custom",
)
# These spellings only make sense for one granularity.
COMPARISON_GRANULARITY = {"mom": "month", "qoq": "quarter", "wow": "week"}

NULL_MEMBER = "(空值)"  # fixed value: label of the null member of a dimension
TOTAL = "(total)"


class ContractError(ValueError):
    """A declaration that cannot be turned into a plan."""


def ascii_id(text: str | None, fallback: str = "measure") -> str:
    """Identifier made of ASCII letters, digits, ``_`` and ``-`` (lower case)."""
    kept = re.sub(r"[^0-9A-Za-z_\-]+", "_", text or "").strip("_").lower()
    return kept or fallback


@dataclass(frozen=True)
class Measure:
    """How one number is aggregated, in which unit, and which direction is good."""

    id: str
    field: str | None = None
    aggregation: str = "sum"
    unit: str = "unit"
    direction: str = "neutral"
    additivity: str = "additive"
    semantic_type: str = "other"
    label: str | None = None
    dimension_aggregation: str | None = None
    time_aggregation: str | None = None
    storage_scale: str = "raw"
    numerator_field: str | None = None
    denominator_field: str | None = None
    weight_field: str | None = None
    min_weight_coverage_pct: float = 95.0
    unit_field: str | None = None
    primary: bool = False
    required: bool = True
    target_field: str | None = None
    benchmark: float | None = None

    @property
    def within_day(self) -> str:
        """Aggregation across rows of one day (the dimension axis)."""
        return self.dimension_aggregation or self.aggregation

    @property
    def title(self) -> str:
        return self.label or self.field or self.id

    @property
    def source_fields(self) -> tuple[str, ...]:
        if self.aggregation == "ratio":
            names = (self.numerator_field, self.denominator_field)
        else:
            names = (self.field, self.weight_field)
        return tuple(name for name in names if name)

    def problems(self, columns: Iterable[str], has_time: bool) -> list[str]:
        """Everything that makes this declaration unusable on a table with these columns."""
        present = set(columns)
        found = []

        def need(ok: bool, text: str) -> None:
            if not ok:
                found.append(text)

        need(self.aggregation in AGGREGATIONS, f"aggregation={self.aggregation!r} unknown")
        need(self.within_day in AGGREGATIONS,
             f"dimension_aggregation={self.within_day!r} unknown")
        need(self.time_aggregation is None or self.time_aggregation in TIME_AGGREGATIONS,
             f"time_aggregation={self.time_aggregation!r} unknown")
        need(self.direction in DIRECTIONS, f"direction={self.direction!r} unknown")
        need(self.additivity in ADDITIVITY, f"additivity={self.additivity!r} unknown")
        need(self.semantic_type in SEMANTIC_TYPES, f"semantic_type={self.semantic_type!r} unknown")
        need(bool((self.unit or "").strip()), "unit missing")
        is_ratio = self.aggregation == "ratio"
        need(is_ratio or bool(self.field), "field missing")
        need(not self.field or self.field in present, f"column {self.field} missing")
        need(not self.unit_field or self.unit_field in present,
             f"unit column {self.unit_field} missing")
        if is_ratio:
            need(self.numerator_field in present, "ratio needs an existing numerator_field")
            need(self.denominator_field in present, "ratio needs an existing denominator_field")
        else:
            need(not (self.numerator_field or self.denominator_field),
                 "numerator_field and denominator_field belong to ratio only")
        need(self.aggregation != "weighted_mean" or self.weight_field in present,
             "weighted_mean needs an existing weight_field")
        need(0 <= self.min_weight_coverage_pct <= 100, "min_weight_coverage_pct outside 0..100")
        need(not (self.additivity == "semi_additive" and has_time and not self.time_aggregation),
             "semi_additive needs time_aggregation when the table has a time column")
        percent = self.semantic_type in PERCENT_TYPES and self.unit == "percent"
        need(self.storage_scale in (("fraction", "percent") if percent else STORAGE_SCALES),
             f"storage_scale={self.storage_scale!r} not allowed here")
        return found


@dataclass(frozen=True)
class Roles:
    """Which columns of the table play which part."""

    time: str | None = None
    dimensions: tuple[str, ...] = ()
    customer: str | None = None
    product: str | None = None
    target: str | None = None
    id: str | None = None
    amount: str | None = None
    qty: str | None = None

    def named_columns(self) -> list[tuple[str, str]]:
        """(role, column) pairs for every declared column."""
        single = [(role, getattr(self, role))
                  for role in ("time", "target", "customer", "product", "id")]
        return [pair for pair in single if pair[1]] + [("dimension", d) for d in self.dimensions]


@dataclass(frozen=True)
class Scope:
    """The locked period and what it is compared with."""

    mode: str = "period"                 # period | snapshot
    period: str | None = None            # label such as 2025Q4, or a..b; None means infer
    comparison: str = "none"
    baseline_period: str | None = None   # label of a custom baseline
    data_as_of: str | None = None
    comparison_as_of: str | None = None
    granularity: str = "month"           # used for inferred and custom periods
    timezone: str | None = None
    allow_inferred_period: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("period", "snapshot"):
            raise ContractError(f"scope mode {self.mode!r} is neither period nor snapshot")
        if self.comparison not in COMPARISONS:
            raise ContractError(f"comparison {self.comparison!r} unknown")

    @property
    def comparison_type(self) -> str:
        kind = COMPARISONS[self.comparison]
        return kind if kind in TIME_COMPARISONS else "none"


@dataclass(frozen=True)
class Reference:
    """A target, benchmark, band or group that a measure is held against."""

    id: str
    type: str                            # target | benchmark | group
    measure: str
    unit: str | None = None
    value: float | None = None
    lower: float | None = None
    upper: float | None = None
    tolerance: float = 0.0
    direction_rule: str | None = None    # a direction, or closer_to_target
    field: str | None = None
    aggregation: str = "unique"
    grain: tuple[str, ...] = ()
    frequency: str = "period"
    dimension: str | None = None
    reference_group: str | None = None
    required: bool = False
    source: str = "references"           # scope | references | measure | legacy
    parse_block_pct: float = 100.0
    invalid_reason: str | None = None


@dataclass(frozen=True)
class FieldSpec:
    required: bool = False
    type: str | None = None
    unit: str | None = None
    aggregation: str | None = None
    min_valid_ratio: float = 0.95


@dataclass(frozen=True)
class SchemaContract:
    """Declared grain, key and fields of the table."""

    business_grain: str | None = None
    primary_key: tuple[str, ...] | None = None
    fields: dict[str, FieldSpec] = field(default_factory=dict)
    allow_duplicate_primary_key: bool = False


@dataclass(frozen=True)
class Thresholds:
    """Limits of the quality gates, in percent unless named otherwise."""

    time_parse_block_pct: float = 5.0
    measure_missing_block_pct: float = 5.0
    measure_parse_block_pct: float = 5.0
    duplicate_row_block_pct: float = 5.0
    duplicate_value_block_pct: float = 5.0
    period_completeness_block_pct: float = 90.0
    dimension_jaccard_block: float = 0.5
    customer_coverage_min_pct: float = 80.0
    qty_parse_block_pct: float = 5.0
    target_parse_block_pct: float = 5.0
    negative_policy: str = "allow_net"   # allow_net | block
    customer_top5_high: float | None = None


def check_measures(
    measures: Sequence[Measure], columns: Iterable[str], has_time: bool
) -> tuple[list[Measure], list[tuple[str, str, str]]]:
    """Split declarations into usable measures and (severity, code, subject) findings.

    A bad required or primary measure is an error, a bad optional one is left out with a warning.
    Exactly one usable measure ends up primary.
    """
    columns = list(columns)
    kept: list[Measure] = []
    findings: list[tuple[str, str, str]] = []
    seen: set[str] = set()
    for measure in measures:
        problems = measure.problems(columns, has_time)
        if measure.id in seen:
            problems.append("id repeated")
        if problems:
            severity = "error" if measure.required or measure.primary else "warning"
            findings.append((severity, "measure_contract_invalid",
                             f"{measure.id}: {'; '.join(problems)}"))
            continue
        seen.add(measure.id)
        kept.append(measure)
    if not kept:
        findings.append(("error", "no_usable_measure", "measures"))
        return [], findings
    primaries = [m for m in kept if m.primary]
    if len(primaries) != 1:
        findings.append(("error", "primary_measure_count", str(len(primaries))))
        lead = primaries[0] if primaries else kept[0]
        kept = [_with_primary(m, m is lead) for m in kept]
    return kept, findings


def _with_primary(measure: Measure, flag: bool) -> Measure:
    if measure.primary == flag:
        return measure
    values = {name: getattr(measure, name) for name in measure.__dataclass_fields__}
    return Measure(**{**values, "primary": flag})


def primary_of(measures: Sequence[Measure]) -> Measure:
    return next((m for m in measures if m.primary), measures[0])
