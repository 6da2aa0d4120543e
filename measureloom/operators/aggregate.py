"""Aggregate measures by dimension members, over time, and over both axes.

``member_facts`` is the central plan: one scan, one shuffle, all dimensions and the total through
grouping sets, both period sides through conditional aggregates. Measures that need more than sums
(exact medians, distinct counts, two-axis measures) share it: a row also counts under a mark of the
measure and a key, its value's bucket or its day. A second scan serves all distinct counts and all
medians that the buckets leave open.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measureloom.contract import TOTAL, Measure
from measureloom.functions import calendar as cal
from measureloom.functions import cleaning
from measureloom.functions import sums
from measureloom.functions.sums import steady_sum
from measureloom.operators.onerow import attach
from measureloom.operators import quantiles as q
from measureloom.operators.quantiles import exact_quantiles
from measureloom.operators.scope import BASE, CURRENT, Lock, in_scope, roles, side_flags
from measureloom.session import cut_lineage

COMBINABLE = ("sum", "mean", "weighted_mean", "min", "max", "count", "ratio")
DAY = "_day"


def _private(dims: Sequence[str]) -> list[str]:
    """Column names of dimensions inside a plan, where no input or result column can clash."""
    return [f"_dim{k}" for k in range(len(dims))]


def _public(by: Sequence[str], taken: Sequence[str]) -> list[str]:
    """Names under which members come out: their own, unless a result column has it."""
    return [f"member_{d}" if d in taken else d for d in by]


def _members(by: Sequence[str]) -> list[Column]:
    return [cleaning.member(F.col(f"`{d}`")).alias(p) for d, p in zip(by, _private(by), strict=True)]


def _cols(measure: Measure) -> dict[str, str]:
    return {part: f"_{part}_{measure.id}" for part in ("value", "weight", "top", "bottom")}


def prepare(df: DataFrame, measures: Sequence[Measure], keep: Sequence[str | Column] = (),
            time: str | None = None, timezone: str | None = None) -> DataFrame:
    """Project the table down to what aggregation needs: kept columns, day, numeric inputs."""
    out: list[Column] = [F.col(f"`{c}`") if isinstance(c, str) else c for c in keep]
    if time is not None:
        out.append(F.to_date(cleaning.timestamp(df, time, timezone)).alias(DAY))
    for m in measures:
        names = _cols(m)
        out.append(cleaning.row_value(df, m).alias(names["value"]))
        if m.aggregation == "weighted_mean" or m.within_day == "weighted_mean":
            out.append(cleaning.number(df, m.weight_field).alias(names["weight"]))
        if m.aggregation == "ratio":
            out.append(cleaning.number(df, m.numerator_field).alias(names["top"]))
            out.append(cleaning.number(df, m.denominator_field).alias(names["bottom"]))
    return df.select(*out)


def combine(measure: Measure, how: str, guard: Column | None = None) -> Column:
    """Aggregate expression of a prepared measure over the rows where ``guard`` holds."""
    n = {part: F.col(name) for part, name in _cols(measure).items()}

    def only(value: Column, *more: Column) -> Column:
        tests = [t for t in (guard, *more) if t is not None]
        return F.when(reduce(lambda a, b: a & b, tests), value) if tests else value

    if how == "sum":
        return steady_sum(only(n["value"]))
    if how == "mean":
        return steady_sum(only(n["value"])) / F.count(only(n["value"]))
    if how == "min":
        return F.min(only(n["value"]))
    if how == "max":
        return F.max(only(n["value"]))
    if how == "count":
        seen = F.count(F.lit(1)) if guard is None else F.count_if(guard)
        return F.when(seen > 0, F.count(only(n["value"])).cast("double"))
    if how == "weighted_mean":
        usable = n["value"].isNotNull() & (n["weight"] > 0)
        return (steady_sum(only(n["value"] * n["weight"], usable))
                / steady_sum(only(n["weight"], usable)))
    if how == "ratio":
        usable = n["top"].isNotNull() & (n["bottom"] > 0)
        value = steady_sum(only(n["top"], usable)) / steady_sum(only(n["bottom"], usable))
        return value * 100 if measure.unit == "percent" else value
    raise ValueError(f"{how!r} is not combined from partial aggregates")


def group_value(rows: DataFrame, keys: Sequence[str], measure: Measure, how: str) -> DataFrame:
    """One aggregate of a prepared measure per key, as column ``value``; any aggregation."""
    keys = list(keys)
    value = _cols(measure)["value"]
    if how in COMBINABLE:
        return rows.groupBy(*keys).agg(combine(measure, how).alias("value"))
    if how == "distinct_count":
        return rows.groupBy(*keys).agg(F.count_distinct(F.col(value)).cast("double").alias("value"))
    if how == "median":
        return exact_quantiles(rows, keys, value, {"value": 0.5})
    raise ValueError(f"aggregation {how!r} unknown")


def across_days(daily: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Second axis: combine one value per day into one value per key.

    Days are bounded by the calendar, so the built-in exact median is safe here. Days without a
    value are dropped first, hence ``ending`` and ``last_non_null`` are the same.
    """
    v = F.col("value")
    rule = {
        "sum": steady_sum(v), "mean": steady_sum(v) / F.count(v), "min": F.min(v), "max": F.max(v),
        "median": F.median(v),
        "ending": F.max_by(v, F.when(v.isNotNull(), F.col(DAY))),
        "last_non_null": F.max_by(v, F.when(v.isNotNull(), F.col(DAY))),
    }[how]
    return daily.groupBy(*keys).agg(rule.alias("value"))


def aggregate(rows: DataFrame, keys: Sequence[str], measure: Measure) -> DataFrame:
    """Declared aggregate per key. Two-axis measures go day by day when rows carry a day."""
    keys = list(keys)
    if measure.time_aggregation and DAY in rows.columns:
        dated = rows.where(F.col(DAY).isNotNull())
        daily = group_value(dated, [*keys, DAY], measure, measure.within_day)
        return across_days(daily, keys, measure.time_aggregation)
    return group_value(rows, keys, measure, measure.aggregation)


def _single_pass(measure: Measure, has_day: bool) -> bool:
    two_axis = bool(measure.time_aggregation) and has_day
    return measure.aggregation in COMBINABLE and not two_axis


def _sided(rows: DataFrame, dims: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Grouping sets over every dimension plus the total, both sides at once."""
    values = []
    for m in measures:
        values += [combine(m, m.aggregation, F.col(CURRENT)).alias(f"c_{m.id}"),
                   combine(m, m.aggregation, F.col(BASE)).alias(f"b_{m.id}")]
    present = [F.count_if(F.col(CURRENT)).alias("_nc"), F.count_if(F.col(BASE)).alias("_nb")]
    tidy = [F.struct(F.lit(m.id).alias("measure_id"), F.col(f"c_{m.id}").alias("current"),
                     F.col(f"b_{m.id}").alias("baseline")) for m in measures]
    keys = _private(dims)
    if dims:
        name, which = F.lit(TOTAL), F.lit(TOTAL)
        for d, k in zip(dims, keys, strict=True):
            own = F.grouping(F.col(k)) == 0
            name = F.when(own, F.col(k)).otherwise(name)
            which = F.when(own, F.lit(d)).otherwise(which)
        sets = [[F.col(k)] for k in keys] + [[]]
        grouped = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(
            which.alias("dimension"), name.alias("name"), *values, *present)
    else:
        grouped = rows.agg(*values, *present).select(
            F.lit(TOTAL).alias("dimension"), F.lit(TOTAL).alias("name"), "*")
    return (grouped.where((F.col("_nc") > 0) | (F.col("_nb") > 0))
            .select("dimension", "name", (F.col("_nc") > 0).alias("in_current"),
                    (F.col("_nb") > 0).alias("in_base"),
                    F.explode(F.array(*tidy)).alias("m"))
            .select("m.measure_id", "dimension", "name", "m.current", "m.baseline",
                    "in_current", "in_base"))


def _by_role(rows: DataFrame, dims: Sequence[str], measure: Measure) -> DataFrame:
    """Same result for one measure that needs its own plan: sides and dimensions as keys."""
    members = [F.struct(F.lit(d).alias("dimension"), F.col(k).alias("name"))
               for d, k in zip(dims, _private(dims), strict=True)]
    members.append(F.struct(F.lit(TOTAL).alias("dimension"), F.lit(TOTAL).alias("name")))
    needed = [c for c in _cols(measure).values() if c in rows.columns]
    if DAY in rows.columns:
        needed.append(DAY)
    keyed = (roles(rows).select("period_role", F.explode(F.array(*members)).alias("d"), *needed)
             .select("period_role", "d.dimension", "d.name", *needed))
    keys = ["period_role", "dimension", "name"]
    value = aggregate(keyed, keys, measure)
    two_axis = measure.time_aggregation and DAY in rows.columns
    if (measure.within_day if two_axis else measure.aggregation) == "median":
        # Quantiles leave out members without any readable value; they still are members.
        present = keyed.groupBy(*keys).agg(F.lit(True).alias("_seen"))
        value = present.join(value, keys, "left").drop("_seen")
    is_current = F.col("period_role") == "current"
    return (value.groupBy("dimension", "name").agg(
                F.max(F.when(is_current, F.col("value"))).alias("current"),
                F.max(F.when(~is_current, F.col("value"))).alias("baseline"),
                F.max(is_current).alias("in_current"), F.max(~is_current).alias("in_base"))
            .select(F.lit(measure.id).alias("measure_id"), "dimension", "name", "current",
                    "baseline", "in_current", "in_base"))


def scoped_rows(df: DataFrame, measures: Sequence[Measure], dims: Sequence[str], lock: Lock,
                time: str | None, timezone: str | None = None,
                extra: Sequence[str | Column] = ()) -> DataFrame:
    """Rows of the locked scope, tagged and projected: members, day, numeric inputs.

    Members are in ``_dim0``, ``_dim1`` and so on, so that a dimension may have any name.
    """
    current, base = side_flags(df, lock, time, timezone)
    flags = [current.alias(CURRENT), base.alias(BASE)]
    return prepare(in_scope(df, lock, time, timezone), measures,
                   [*_members(dims), *extra, *flags], time, timezone)


def _kind(measure: Measure, has_day: bool) -> str:
    """How a measure is computed: sums, days, median, distinct, or own (two axes that are not sums)."""
    if measure.time_aggregation and has_day:
        return "days" if measure.within_day in COMBINABLE else "own"
    return {"median": "median", "distinct_count": "distinct"}.get(measure.aggregation, "sums")


_VALUE, _MARK = "_v", "_mark"
_AT = ["dimension", "name"]


def _exploded(rows: DataFrame, dims: Sequence[str], marks: Sequence[Column]) -> DataFrame:
    """Every row once per member it belongs to, the total included, and per mark (mark, key, v)."""
    members = [F.struct(F.lit(d).alias("dimension"), F.col(k).alias("name"))
               for d, k in zip(dims, _private(dims), strict=True)]
    members.append(F.struct(F.lit(TOTAL).alias("dimension"), F.lit(TOTAL).alias("name")))
    flat = rows.withColumn("_d", F.explode(F.array(*members))).withColumn("_m", F.explode(F.array(*marks)))
    return flat.select(*[c for c in rows.columns if c not in _private(dims)], "_d.dimension", "_d.name",
                       F.col("_m.mark").alias(_MARK), F.col("_m.key").alias("_key"), F.col("_m.v").alias(_VALUE))


def _mark(i: int, key: Column | None, value: Column | None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(i).alias("mark"), (null if key is None else key).cast("double").alias("key"),
                    (null if value is None else value).cast("double").alias("v"))


def _value_of(measure: Measure) -> Column:
    # Adding zero makes one value of the two zeros.
    return F.col(_cols(measure)["value"]) + F.lit(0.0)


def _sides(counters: DataFrame, **columns: tuple[Column, Column]) -> DataFrame:
    """Rows per side, c and b, from pairs of columns."""
    sides = [F.struct(F.lit(side).alias("_side"), *[pair[k].alias(n) for n, pair in columns.items()])
             for k, side in enumerate("cb")]
    kept = [c for c in (*_AT, _MARK, "_key", "_b", _VALUE) if c in counters.columns and c not in columns]
    return counters.select(*kept, F.explode(F.array(*sides)).alias("_e")).select(*kept, "_e.*")


def _shared(rows: DataFrame, dims: Sequence[str], measures: Sequence[Measure], has_day: bool) -> DataFrame:
    """Facts of measures of any kind but own, from two scans of the rows at most."""
    marks = {i: m for i, m in enumerate(measures, 1) if _kind(m, has_day) in ("days", "median")}
    sums = [m for m in measures if _kind(m, has_day) == "sums"]
    entries = [_mark(0, None, None)]
    for i, m in marks.items():
        entries.append(_mark(i, F.unix_date(DAY), None) if _kind(m, has_day) == "days"
                       else _mark(i, q.bucket(_value_of(m)), _value_of(m)))
    values, v = [], F.col(_VALUE)
    for m, how, mark in [*((m, m.aggregation, 0) for m in sums),
                         *((m, m.within_day, i) for i, m in marks.items() if _kind(m, has_day) == "days")]:
        for side, flag in (("c", CURRENT), ("b", BASE)):
            values.append(combine(m, how, F.col(flag) & (F.col(_MARK) == mark)).alias(f"{side}_{m.id}"))
    for side, flag in (("c", CURRENT), ("b", BASE)):
        mine = F.when(F.col(flag), v)
        values += [F.count_if(F.col(flag)).alias(f"_n{side}"), F.count(mine).alias(f"_v{side}"),
                   F.min(mine).alias(f"_low{side}"), F.max(mine).alias(f"_high{side}")]
    counters = cut_lineage(_exploded(rows, dims, entries).groupBy(*_AT, _MARK, "_key").agg(*values))
    seen = counters.where(F.col(_MARK) == 0).select(
        *_AT, (F.col("_nc") > 0).alias("in_current"), (F.col("_nb") > 0).alias("in_base")).where("in_current or in_base")
    parts = []
    if sums:
        tidy = [F.struct(F.lit(m.id).alias("measure_id"), F.col(f"c_{m.id}").alias("current"),
                         F.col(f"b_{m.id}").alias("baseline")) for m in sums]
        parts.append(counters.where((F.col(_MARK) == 0) & ((F.col("_nc") > 0) | (F.col("_nb") > 0))).select(
            *_AT, (F.col("_nc") > 0).alias("in_current"), (F.col("_nb") > 0).alias("in_base"),
            F.explode(F.array(*tidy)).alias("m")).select("m.measure_id", *_AT, "m.current", "m.baseline", "in_current", "in_base"))
    for i, m in marks.items():
        if _kind(m, has_day) == "days":
            daily = _sides(counters.where((F.col(_MARK) == i) & F.col("_key").isNotNull()),
                           value=(F.col(f"c_{m.id}"), F.col(f"b_{m.id}")), _n=(F.col("_nc"), F.col("_nb")))
            daily = daily.where("_n > 0").withColumnRenamed("_key", DAY)
            parts.append(_both_sides(across_days(daily, ["_side", *_AT], m.time_aggregation), m))
    parts += _second_scan(rows, dims, measures, marks, counters, seen, has_day)
    return reduce(DataFrame.unionByName, parts)


def _both_sides(values: DataFrame, measure: Measure, seen: DataFrame | None = None) -> DataFrame:
    """Facts of one measure from (_side, dimension, name, value); members without value by ``seen``."""
    side = F.col("_side") == "c"
    wide = values.groupBy(*_AT).agg(
        F.max(F.when(side, F.col("value"))).alias("current"), F.max(F.when(~side, F.col("value"))).alias("baseline"),
        F.max(side).alias("in_current"), F.max(~side).alias("in_base"))
    if seen is not None:
        wide = seen.join(wide.drop("in_current", "in_base"), _AT, "left")
    return wide.select(F.lit(measure.id).alias("measure_id"), *_AT, "current", "baseline", "in_current", "in_base")


def _second_scan(rows: DataFrame, dims: Sequence[str], measures: Sequence[Measure], marks: dict[int, Measure],
                 counters: DataFrame, seen: DataFrame, has_day: bool) -> list[DataFrame]:
    """Facts of medians and distinct counts; the rows are read if there are any of the latter or open ranks."""
    medians = {i: m for i, m in marks.items() if _kind(m, has_day) == "median"}
    distinct = {i: m for i, m in enumerate(measures, 1) if _kind(m, has_day) == "distinct"}
    by, found, hits, few, is_open = ["_side", *_AT, _MARK], None, None, None, False
    if medians:
        mine = counters.where(F.col(_MARK).isin(list(medians)) & F.col("_key").isNotNull())
        mine = _sides(mine.withColumn("_b", F.col("_key").cast("int")), _n=(F.col("_vc"), F.col("_vb")),
                      _low=(F.col("_lowc"), F.col("_lowb")), _high=(F.col("_highc"), F.col("_highb"))).where("_n > 0")
        hits = cut_lineage(q.located(mine.drop("_key"), by, [0.5]))
        found = q.known_values(hits, by)
        count, few = q.sent(hits, [*_AT, _MARK])
        is_open = count > 0
    if distinct or is_open:
        read = [_mark(i, q.bucket(_value_of(m)), _value_of(m)) for i, m in medians.items() if is_open]
        read += [_mark(i, F.lit(0), _value_of(m)) for i, m in distinct.items()]
        flat = _exploded(rows, dims, read).where(F.col(_VALUE).isNotNull()).withColumn("_b", F.col("_key").cast("int"))
        if is_open and few is not None:
            flat = flat.join(few.withColumn("_hit", F.lit(True)), [*_AT, _MARK, "_b"], "left").where(
                F.col("_hit") | F.col(_MARK).isin(list(distinct)))
        pairs = cut_lineage(flat.groupBy(*_AT, _MARK, "_b", _VALUE).agg(
            F.count_if(F.col(CURRENT)).alias("_nc"), F.count_if(F.col(BASE)).alias("_nb")))
        if is_open:
            sided = _sides(pairs.where(F.col(_MARK).isin(list(medians))), _c=(F.col("_nc"), F.col("_nb"))).where("_c > 0")
            found = found.unionByName(q.open_values(sided, by, hits))
        counts = pairs.groupBy(*_AT, _MARK).agg(F.count_if(F.col("_nc") > 0).cast("double").alias("_dc"),
                                                F.count_if(F.col("_nb") > 0).cast("double").alias("_db"))
    parts = []
    if medians:
        middle = q.interpolated(found, by, {"value": 0.5})
        parts += [_both_sides(middle.where(F.col(_MARK) == i), m, seen) for i, m in medians.items()]
    for i, m in distinct.items():
        known = seen.join(counts.where(F.col(_MARK) == i), _AT, "left")
        parts.append(known.select(
            F.lit(m.id).alias("measure_id"), *_AT, F.when(F.col("in_current"), F.coalesce("_dc", F.lit(0.0))).alias("current"),
            F.when(F.col("in_base"), F.coalesce("_db", F.lit(0.0))).alias("baseline"), "in_current", "in_base"))
    return parts


def member_facts(df: DataFrame, measures: Sequence[Measure], dims: Sequence[str], lock: Lock,
                 time: str | None, timezone: str | None = None,
                 write_once: bool = False) -> DataFrame:
    """(measure_id, dimension, name, current, baseline, in_current, in_base) for every member.

    The grand total is the member ``(total)`` of dimension ``(total)``. Null members are a group.
    Plain sums are one lazy plan. With medians, distinct counts or two-axis measures the counters of
    the first scan are made when this is called, and a second scan follows only for what they leave
    open; ``write_once`` writes the projected rows in between, which pays when ``df`` is an expensive
    join.
    """
    has_day = time is not None
    shared = [m for m in measures if _kind(m, has_day) != "own"]
    own = [m for m in measures if _kind(m, has_day) == "own"]
    only_sums = all(_kind(m, has_day) == "sums" for m in shared)
    written = None
    if write_once and (own or not only_sums):
        written = cut_lineage(scoped_rows(df, measures, dims, lock, time, timezone))

    def rows_of(chosen: Sequence[Measure]) -> DataFrame:
        if written is not None:
            return written
        return scoped_rows(df, chosen, dims, lock, time, timezone)

    parts = []
    if shared:
        parts.append(_sided(rows_of(shared).drop(DAY), dims, shared) if only_sums
                     else _shared(rows_of(shared), dims, shared, has_day))
    parts += [_by_role(rows_of([m]), dims, m) for m in own]
    return reduce(DataFrame.unionByName, parts)


def grouped(df: DataFrame, measures: Sequence[Measure], by: Sequence[str], time: str | None = None,
            timezone: str | None = None) -> DataFrame:
    """Declared aggregates of several measures per key over all rows, one column per measure."""
    by, keys = list(by), _private(by)
    light = [m for m in measures if _single_pass(m, time is not None)]
    heavy = [m for m in measures if m not in light]
    parts = []
    if light:
        rows = prepare(df, light, _members(by))
        parts.append(rows.groupBy(*keys).agg(*[combine(m, m.aggregation).alias(m.id) for m in light]))
    for m in heavy:
        rows = prepare(df, [m], _members(by), time if m.time_aggregation else None, timezone)
        parts.append(aggregate(rows, keys, m).withColumnRenamed("value", m.id))
    if not by:
        return attach(*parts)
    joined = reduce(lambda a, b: a.join(b, keys, "full"), parts)
    ids = [m.id for m in measures]
    return joined.select(*[F.col(k).alias(n) for k, n in zip(keys, _public(by, ids), strict=True)], *ids)


def distribution(df: DataFrame, measures: Sequence[Measure], lock: Lock, time: str | None,
                 timezone: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count, min, quartiles, max and mean of row values in the current period."""
    rows = scoped_rows(df, measures, list(by), lock, time, timezone).where(F.col(CURRENT))
    pieces = F.array(*[F.struct(F.lit(m.id).alias("measure_id"),
                                F.col(_cols(m)["value"]).alias("value")) for m in measures])
    dims = _private(by)
    tidy = rows.select(*dims, F.explode(pieces).alias("m")).select(*dims, "m.*").where(
        F.col("value").isNotNull())
    keys = [*dims, "measure_id"]
    summary = exact_quantiles(
        tidy, keys, "value", {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0},
        summary=True)
    out = ["measure_id", "count", "min", "p25", "median", "p75", "max", "mean"]
    shown = [F.col(k).alias(n) for k, n in zip(dims, _public(by, out), strict=True)]
    return summary.select(*shown, *out)


def monthly_series(df: DataFrame, measures: Sequence[Measure], time: str,
                   timezone: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(measure_id, month, value) over all valid dates; months without a value are absent.

    Members come out under their own names; one named like a result column, say value, comes out as
    ``member_value``.
    """
    dims = _private(by)

    def monthly(chosen: Sequence[Measure]) -> DataFrame:
        rows = prepare(df, chosen, _members(by), time, timezone).where(F.col(DAY).isNotNull())
        return rows.withColumn("month", F.to_date(F.trunc(F.col(DAY), "month")))

    keys = [*dims, "month"]
    parts = []
    light = [m for m in measures if _single_pass(m, True)]
    if light:
        wide = monthly(light).groupBy(*keys).agg(
            *[combine(m, m.aggregation).alias(m.id) for m in light])
        tidy = F.array(*[F.struct(F.lit(m.id).alias("measure_id"), F.col(m.id).alias("value"))
                         for m in light])
        parts.append(wide.select(*keys, F.explode(tidy).alias("m")).select("m.*", *keys))
    for m in measures:
        if m not in light:
            parts.append(aggregate(monthly([m]), keys, m).withColumn("measure_id", F.lit(m.id)))
    series = reduce(DataFrame.unionByName, parts)
    shown = [F.col(k).alias(n) for k, n in zip(
        dims, _public(by, ("measure_id", "month", "value")), strict=True)]
    return series.where(F.col("value").isNotNull()).select("measure_id", *shown, "month", "value")


def _terms(measure: Measure) -> list[Column]:
    """Columns whose sums make a combined measure; none for extremes."""
    n = {part: F.col(name) for part, name in _cols(measure).items()}
    one = F.when(n["value"].isNotNull(), 1.0)
    weighed = n["value"].isNotNull() & (n["weight"] > 0)
    divided = n["top"].isNotNull() & (n["bottom"] > 0)
    return {
        "sum": lambda: [n["value"]], "mean": lambda: [n["value"], one], "count": lambda: [one],
        "weighted_mean": lambda: [F.when(weighed, n["value"] * n["weight"]), F.when(weighed, n["weight"])],
        "ratio": lambda: [F.when(divided, n["top"]), F.when(divided, n["bottom"])],
        "min": lambda: [], "max": lambda: []}[measure.aggregation]()


def _crossed(rows: DataFrame, measures: Sequence[Measure], keys: Sequence[str]) -> DataFrame:
    """Pieces of sums and extremes of all combinations of the keys, to be grouped further by ``_merged``."""
    held = [F.count(F.lit(1)).alias("_n")]
    for i, m in enumerate(measures):
        if m.aggregation in ("min", "max"):
            held.append(getattr(F, m.aggregation)(F.col(_cols(m)["value"])).alias(f"_x{i}"))
        for j, term in enumerate(_terms(m)):
            held += [F.sum(piece).alias(f"_s{i}_{j}_{k}") for k, piece in enumerate(sums.pieces(term))]
    return rows.groupBy(*keys).agg(*held)


def _merged(measure: Measure, i: int, guard: Column | None) -> Column:
    """``combine`` over the rows of ``_crossed``, where the measure is the ``i``-th."""
    def only(name: str) -> Column:
        return F.col(name) if guard is None else F.when(guard, F.col(name))

    if measure.aggregation in ("min", "max"):
        return getattr(F, measure.aggregation)(only(f"_x{i}"))
    total = [sums.joined(*[F.sum(only(f"_s{i}_{j}_{k}")) for k in range(3)]) for j in range(len(_terms(measure)))]
    if measure.aggregation == "count":
        return F.when(F.coalesce(F.sum(only("_n")), F.lit(0)) > 0, F.coalesce(total[0], F.lit(0.0)))
    value = total[0] if len(total) == 1 else total[0] / total[1]
    return value * 100 if measure.aggregation == "ratio" and measure.unit == "percent" else value


def _few_combinations(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the keys have far fewer combinations than there are rows, from one scan."""
    known = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).head()
    return 16 * known[1] <= known[0]


def facts_and_series(df: DataFrame, measures: Sequence[Measure], dims: Sequence[str], lock: Lock, time: str,
                     timezone: str | None = None, cheap: bool = False) -> tuple[DataFrame, DataFrame]:
    """``member_facts`` of the locked scope and ``monthly_series`` of all dates, from one scan.

    The months are one more grouping set next to the dimensions and the total. Its partial results
    are written once when this is called. Measures that are not plain sums follow by plans of their own.
    Where ``df`` is ``cheap`` to scan, the combinations of members and months are estimated first; when
    they are few, rows are combined to them before they are multiplied by the grouping sets.
    """
    light = [m for m in measures if _kind(m, True) == "sums"]
    heavy = [m for m in measures if m not in light]
    facts, series = [], []
    if light:
        flags = [c.alias(n) for c, n in zip(side_flags(df, lock, time, timezone), (CURRENT, BASE), strict=True)]
        rows = prepare(df, light, [*_members(dims), *flags], time, timezone).withColumn(
            "_month", F.to_date(F.trunc(F.col(DAY), "month")))
        keys, name, which = _private(dims), F.lit(TOTAL), F.lit(TOTAL)
        crossing = [*keys, "_month", CURRENT, BASE]
        few = cheap and _few_combinations(rows, crossing)
        if few:
            rows = _crossed(rows, light, crossing)
        values = [(_merged(m, i, guard) if few else combine(m, m.aggregation, guard)).alias(f"{side}_{m.id}")
                  for i, m in enumerate(light)
                  for side, guard in (("c", F.col(CURRENT)), ("b", F.col(BASE)), ("a", None))]
        for d, k in zip(dims, keys, strict=True):
            own = F.grouping(F.col(k)) == 0
            name, which = F.when(own, F.col(k)).otherwise(name), F.when(own, F.lit(d)).otherwise(which)
        sets = [[F.col(k)] for k in (*keys, "_month")] + [[]]
        grouped = cut_lineage(rows.groupingSets(sets, *[F.col(k) for k in (*keys, "_month")]).agg(
            which.alias("dimension"), name.alias("name"), (F.grouping(F.col("_month")) == 0).alias("_monthly"), *values,
            (F.count_if(F.col(CURRENT)) > 0).alias("in_current"), (F.count_if(F.col(BASE)) > 0).alias("in_base")
        ).drop(*keys))
        tidy = F.explode(F.array(*[F.struct(
            F.lit(m.id).alias("measure_id"), F.col(f"c_{m.id}").alias("current"), F.col(f"b_{m.id}").alias("baseline"),
            F.col(f"a_{m.id}").alias("value")) for m in light])).alias("m")
        facts.append(grouped.where("not _monthly and (in_current or in_base)").select(
            *_AT, "in_current", "in_base", tidy).select("m.measure_id", *_AT, "m.current", "m.baseline", "in_current", "in_base"))
        series.append(grouped.where("_monthly and _month is not null").select(F.col("_month").alias("month"), tidy).select(
            "m.measure_id", "month", "m.value").where("value is not null"))
    if heavy:
        facts.append(member_facts(df, heavy, dims, lock, time, timezone))
        series.append(monthly_series(df, heavy, time, timezone))
    return reduce(DataFrame.unionByName, facts), reduce(DataFrame.unionByName, series)


def period_series(df: DataFrame, measure: Measure, time: str, frequency: str,
                  timezone: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Declared aggregate per calendar period of any supported frequency."""
    dims = _private(by)
    rows = prepare(df, [measure], _members(by), time, timezone).where(F.col(DAY).isNotNull())
    rows = rows.withColumn("period", cal.period_key(F.col(DAY), frequency))
    shown = [F.col(k).alias(n) for k, n in zip(dims, _public(by, ("period", "value")), strict=True)]
    return aggregate(rows, [*dims, "period"], measure).select(*shown, "period", "value")


def year_month_matrix(df: DataFrame, measure: Measure, lock: Lock, time: str,
                      timezone: str | None = None, scale: float = 1.0) -> DataFrame:
    """(year, month, value): row values summed over the locked scope."""
    rows = scoped_rows(df, [measure], [], lock, time, timezone)
    return (rows.groupBy(F.year(DAY).alias("year"), F.month(DAY).alias("month"))
            .agg(F.sum(_cols(measure)["value"]).alias("value"))
            .withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)) / F.lit(float(scale))))


def year_month_wide(matrix: DataFrame) -> DataFrame:
    """One row per year with columns m01 … m12."""
    wide = matrix.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("value"))
    return wide.select("year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def window_trend(df: DataFrame, measure: Measure, time: str, start: str, end: str,
                 timezone: str | None = None) -> DataFrame:
    """Monthly sums over an explicit window, one row for every month of it.

    ``missing`` marks months without any row; callers that need a gapless window test for it.
    """
    months = cal.month_calendar(df.sparkSession, start, end)
    rows = prepare(df, [measure], (), time, timezone)
    sums = (rows.groupBy(F.to_date(F.trunc(DAY, "month")).alias("month"))
            .agg(F.sum(_cols(measure)["value"]).alias("value"), F.lit(True).alias("_seen")))
    return months.join(sums, "month", "left").select(
        "month", "value", F.col("_seen").isNull().alias("missing"))
