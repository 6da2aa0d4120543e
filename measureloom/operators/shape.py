"""Rankings, boards, concentration cuts and the row shapes that tables and charts consume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measureloom.contract import NULL_MEMBER, TOTAL, Measure, Thresholds
from measureloom.functions.calendar import month_index
from measureloom.functions.labels import delta_state
from measureloom.operators.compare import measure_attribute
from measureloom.operators.onerow import attach, join_by
from measureloom.operators.ordering import ranked
from measureloom.operators.quantiles import bucket, slice_of

MEMBER_GROUP = ("measure_id", "dimension")


def member_order() -> list[Column]:
    """Current descending with nulls last, members of the baseline only after all others."""
    return [F.col("in_current").desc(), F.col("current").desc_nulls_last(),
            F.col("baseline").desc_nulls_last(), F.col("name").asc()]


def rank_members(rows: DataFrame) -> DataFrame:
    """Rank of every member within its measure and dimension; any number of members."""
    return ranked(rows, MEMBER_GROUP, member_order())


def top_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
          salt: int = 64) -> DataFrame:
    """First ``n`` rows per group with their ``rank``.

    Each group is cut in salted slices first, so a huge group never meets in one task; at most
    ``salt * n`` rows per group reach the final order.
    """
    group = list(group)
    sliced = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salt)))
    local = sliced.withColumn("_p", F.row_number().over(
        W.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("_p") <= n)
    final = W.partitionBy(*group).orderBy(*order)
    return (local.drop("_p", "_salt").withColumn("rank", F.row_number().over(final))
            .where(F.col("rank") <= n))


def mover_board(rows: DataFrame, direction: str, n: int | None = None) -> DataFrame:
    """Growth (largest gains first) or decline (largest losses first) board."""
    if direction == "growth":
        picked, first = rows.where(F.col("delta") > 0), F.col("delta").desc()
    elif direction == "decline":
        picked, first = rows.where(F.col("delta") < 0), F.col("delta").asc()
    else:
        raise ValueError("direction is growth or decline")
    order = [first, F.col("name").asc()]
    return _board(picked, order, n)


def contribution_board(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Members by the size of their contribution, whichever way it points."""
    picked = rows.where(F.col("contribution_pp").isNotNull())
    return _board(picked, [F.abs("contribution_pp").desc(), F.col("name").asc()], n)


def _board(rows: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    if n is None:
        return ranked(rows, MEMBER_GROUP, order)
    return top_n(rows, MEMBER_GROUP, order, n)


# --- concentration -----------------------------------------------------------------------------

def _crossings(level: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Keep the rows in which a wanted share is crossed, largest first within ``by``.

    ``_goals`` holds, per wanted share, the count and the sum of everything larger than the
    group; kept rows carry them forward including the larger rows of the group.
    """
    w = W.partitionBy(*by).orderBy(F.col(order).desc())
    above = w.rowsBetween(W.unboundedPreceding, -1)
    run = (level.withColumn("_pn", F.coalesce(F.sum("_n").over(above), F.lit(0)))
           .withColumn("_ps", F.coalesce(F.sum("_sum").over(above), F.lit(0.0)))
           .withColumn("_last", F.lead(order).over(w).isNull()))
    moved = F.transform("_goals", lambda g: F.struct(
        g["goal"].alias("goal"), g["p"].alias("p"),
        (g["count"] + F.col("_pn")).alias("count"), (g["sum"] + F.col("_ps")).alias("sum")))
    total = F.nullif(F.col("_total"), F.lit(0.0))
    crossed = F.filter(moved, lambda g: (g["sum"] / total < g["p"]) & (
        F.col("_last") | ((g["sum"] + F.col("_sum")) / total >= g["p"])))
    return run.withColumn("_goals", crossed).where(F.size("_goals") > 0).drop("_pn", "_ps", "_last")


def members_to_reach(objects: DataFrame, shares: dict[str, float]) -> DataFrame:
    """How many of the largest objects are needed to reach each share of the sum, exactly.

    ``objects`` have a ``value``. The same descent as for exact quantiles: sums of logarithmic
    buckets, of linear slices of the crossed bucket, then of the few values of the crossed slice.
    Equal values cost one row however many objects carry them, and no step orders more rows than
    there are buckets or slices.
    """
    pairs = (objects.select(F.col("value").alias("_v")).where(F.col("_v").isNotNull())
             .groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", bucket(F.col("_v"))))
    weight = F.sum(F.col("_v") * F.col("_c")).alias("_sum")
    edges = [F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    coarse = pairs.groupBy("_b").agg(F.sum("_c").alias("_n"), weight, *edges)
    goals = F.array(*[F.struct(
        F.lit(name).alias("goal"), F.lit(float(p)).alias("p"),
        F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("sum"))
        for name, p in shares.items()])
    coarse = coarse.withColumn("_total", F.sum("_sum").over(W.partitionBy())).withColumn(
        "_goals", goals)
    coarse = _crossings(coarse, [], "_b").select("_b", "_low", "_high", "_goals", "_total")
    # One bucket and one slice per wanted share are open: a handful of rows.
    sliced = (pairs.join(F.broadcast(coarse), "_b")
              .withColumn("_s", slice_of(F.col("_v"), F.col("_low"), F.col("_high")))
              .groupBy("_b", "_s").agg(
                  F.sum("_c").alias("_n"), weight, F.min("_v").alias("_from"),
                  F.max("_v").alias("_upto"), F.first("_goals").alias("_goals"),
                  F.first("_total").alias("_total")))
    sliced = _crossings(sliced, ["_b"], "_s").select(
        "_b", "_s", "_from", "_upto", "_goals", "_total")
    fine = (pairs.join(F.broadcast(sliced), "_b")
            .where(F.col("_v").between(F.col("_from"), F.col("_upto")))
            .select("_b", "_s", "_v", F.col("_c").alias("_n"),
                    (F.col("_v") * F.col("_c")).alias("_sum"), "_goals", "_total"))
    hit = _crossings(fine, ["_b", "_s"], "_v").select(
        "_v", "_n", "_total", F.explode("_goals").alias("g"))
    # Copies of the crossing value that still stay below the share, plus the one that reaches it.
    gap = F.col("g.p") * F.col("_total") - F.col("g.sum")
    below = F.ceil(gap / F.when(F.col("_v") > 0, F.col("_v")) - 1e-9) - 1
    below = F.greatest(F.lit(0), F.least(F.col("_n"), F.coalesce(below, F.col("_n"))))
    needed = hit.select("g.goal", (F.col("g.count") + below + 1).cast("bigint").alias("needed"))
    return needed.groupBy().agg(*[
        F.max(F.when(F.col("goal") == name, F.col("needed"))).alias(name) for name in shares])


def concentration(facts: DataFrame, measure: Measure, dimension: str,
                  thresholds: Thresholds | None = None) -> DataFrame:
    """One row: identified members, coverage, top shares, members to 50 % and 80 %, status.

    ``facts`` are member facts of the object dimension, read several times: hand in a written copy
    (``cut_lineage``) when they are expensive. Blank and null objects are unidentified.
    """
    limits = thresholds or Thresholds()
    mine = facts.where(F.col("measure_id") == measure.id)
    total = mine.where(F.col("dimension") == TOTAL).agg(F.max("current").alias("total"))
    known = (mine.where((F.col("dimension") == dimension) & F.col("in_current")
                        & (F.trim("name") != "") & (F.col("name") != NULL_MEMBER))
             .select("name", F.col("current").alias("value")))
    sums = known.agg(F.count(F.lit(1)).alias("members"), F.sum("value").alias("identified"),
                     F.coalesce(F.min("value") < 0, F.lit(False)).alias("negative"))
    top = known.orderBy(F.col("value").desc_nulls_last(), "name").limit(10)
    place = F.row_number().over(W.orderBy(F.col("value").desc_nulls_last(), "name"))
    top = top.withColumn("place", place).agg(
        F.sum(F.when(F.col("place") <= 5, F.col("value"))).alias("top5"),
        F.sum("value").alias("top10"))
    reach = members_to_reach(known, {"n50": 0.5, "n80": 0.8})
    row = attach(sums, total, top, reach)
    usable_total = F.when(F.col("total") != 0, F.col("total"))
    coverage = F.col("identified") / usable_total * 100
    identified = F.when(F.col("identified") > 0, F.col("identified"))
    reason = (
        F.when(F.lit(measure.additivity != "additive"), "requires_nonnegative_additive_measure")
        .when(F.col("negative"), "negative_parts")
        .when(F.coalesce(F.col("identified"), F.lit(0.0)) <= 0, "identified_total_not_positive")
        .when(coverage > 100.1, "coverage_above_100")
        .when(coverage.isNull() | (coverage < limits.customer_coverage_min_pct),
              "coverage_below_threshold"))
    partial = reason.isNull() | (reason == "coverage_below_threshold")
    ok = reason.isNull()
    row = row.select(
        F.lit(measure.id).alias("measure_id"), F.lit(dimension).alias("dimension"),
        F.when(F.lit(measure.additivity != "additive"), "SKIPPED")
        .when(ok, "OK").otherwise("BLOCKED").alias("status"),
        reason.alias("reason_code"), "members", coverage.alias("coverage_pct"),
        F.when(partial, F.col("top5") / usable_total * 100).alias("top5_share"),
        F.when(ok, F.col("top10") / usable_total * 100).alias("top10_share"),
        F.when(partial, F.col("top5") / identified * 100).alias("top5_share_identified"),
        F.when(ok, F.col("n50")).alias("n50"), F.when(ok, F.col("n80")).alias("n80"))
    if limits.customer_top5_high is None:
        return row.withColumn("classification", F.lit("descriptive")).withColumn(
            "level", F.lit(None).cast("string"))
    high = F.col("top5_share") >= limits.customer_top5_high
    return row.withColumn("classification", F.lit("policy")).withColumn(
        "level", F.when(F.col("status") == "OK",
                        F.when(high, "high").otherwise("below_high_threshold")))


def pareto_curve(objects: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Every object with its rank and cumulated share of the sum, largest first."""
    total = objects.agg(F.sum(value).alias("_total"))
    run = ranked(objects, [], [F.col(value).desc(), F.col(name).asc()],
                 running={"cumulative": value})
    return attach(run, total).select(
        name, value, "rank", "cumulative",
        (F.col("cumulative") / F.nullif(F.col("_total"), F.lit(0.0)) * 100).alias("cumulative_pct"))


# --- row shapes --------------------------------------------------------------------------------

def ordered_limit(rows: DataFrame, field: str, n: int, ascending: bool = False,
                  tie: Sequence[str] = ("name",)) -> DataFrame:
    """First rows by a field, rows without a value last, ties by name."""
    first = F.col(field).asc_nulls_last() if ascending else F.col(field).desc_nulls_last()
    return rows.orderBy(first, *tie).limit(n)


def rank_table(rows: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """Rows in which every shown column has a value, by the first of them."""
    return ordered_limit(rows.dropna(subset=list(columns)), columns[0], n)


def extreme_split(rows: DataFrame, group: Sequence[str], field: str,
                  ratio: float = 20.0) -> DataFrame:
    """Flag the member that dwarfs the rest: at least ``ratio`` times the second largest.

    Needs three rows with a value. The two largest per group come from a map-side combined
    aggregate, not from sorting the group.
    """
    group = list(group)
    size = F.abs(F.col(field))
    valued = rows.where(F.col(field).isNotNull())
    leads = top_n(valued.select(*group, "name", size.alias("size")), group,
                  [F.col("size").desc(), F.col("name").asc()], 2)
    pair = leads.groupBy(*group).agg(
        F.max(F.when(F.col("rank") == 1, F.col("size"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("size"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("lead"))
    counts = valued.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    pair = join_by(pair, counts, group)
    far = (F.col("_rows") >= 3) & (F.col("first") > 0) & (
        (F.col("second") == 0) | (F.col("first") / F.when(F.col("second") > 0, F.col("second"))
                                  >= ratio))
    pair = pair.select(*group, "lead", F.coalesce(far, F.lit(False)).alias("_far"))
    joined = join_by(valued, pair, group)
    return joined.withColumn("extreme", F.col("_far") & (F.col("name") == F.col("lead"))).drop(
        "lead", "_far")


def trailing_negative_run(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Length of the run of adjacent negative months at the end of each monthly series."""
    w = W.partitionBy(*by).orderBy(F.col("month").desc())
    later = F.lag(month_index(F.col("month"))).over(w)
    stop = (F.col("value") >= 0) | (later.isNotNull() & (later - month_index(F.col("month")) != 1))
    flagged = series.withColumn("_stop", F.coalesce(stop, F.lit(True)).cast("int"))
    flagged = flagged.withColumn("_stops", F.sum("_stop").over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return flagged.groupBy(*by).agg(F.count_if(F.col("_stops") == 0).alias("trailing_negative"))


def regular_months(series: DataFrame, by: Sequence[str], least: int = 4) -> DataFrame:
    """Is each series long enough and without a gap between months."""
    counts = series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(month_index(F.col("month"))).alias("_m"),
        (F.max(month_index(F.col("month"))) - F.min(month_index(F.col("month"))) + 1).alias("_span"))
    regular = (F.col("n") >= least) & (F.col("_m") == F.col("n")) & (F.col("_span") == F.col("n"))
    return counts.select(*by, "n", regular.alias("regular"))


def waterfall(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bridge rows from ordered (step, label, value): floor, rise, fall and running total.

    The first step is the base and the last the closing total; a bridge has a handful of steps.
    """
    w = W.partitionBy(*by).orderBy("step")
    last = F.max("step").over(W.partitionBy(*by))
    first = F.min("step").over(W.partitionBy(*by))
    marked = steps.withColumn("_last", F.col("step") == last).withColumn(
        "_first", F.col("step") == first)
    inner = F.when(F.col("_last"), 0.0).otherwise(F.col("value"))
    end = F.sum(inner).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = marked.withColumn("end", end)
    edge = F.col("_first") | F.col("_last")
    start = F.when(edge, 0.0).otherwise(F.col("end") - F.col("value"))
    return marked.select(
        *by, "step", "label", start.alias("start"), "end",
        F.when(edge, 0.0).otherwise(F.least(start, F.col("end"))).alias("base"),
        F.when(~edge & (F.col("value") >= 0), F.col("value")).alias("increase"),
        F.when(~edge & (F.col("value") < 0), -F.col("value")).alias("decrease"),
        F.when(edge, F.col("end")).alias("total"))


def bridge_steps(bridge: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Price–volume–mix bridge as waterfall steps."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"),
                               F.col(column).alias("value"))
                      for i, (label, column) in enumerate((
                          ("baseline", "base_value"), ("volume", "volume_effect"),
                          ("price_mix", "price_mix_effect"), ("current", "current_value")))])
    return bridge.select(*by, F.explode(steps).alias("s")).select(*by, "s.*")


def heat_table(matrix: DataFrame) -> DataFrame:
    """Cells of a (dimension member × month) matrix with their position between min and max."""
    ends = matrix.agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    width = F.col("_high") - F.col("_low")
    ratio = F.when(width == 0, 0.5).otherwise((F.col("value") - F.col("_low")) / width)
    return attach(matrix, ends).withColumn("ratio", ratio).drop("_low", "_high")


def value_domain(values: DataFrame, by: Sequence[str], field: str = "value",
                 zero_baseline: bool = False, bounded_percent: bool = False,
                 padding: float = 0.08) -> DataFrame:
    """Axis bounds that hold all values with a margin."""
    ends = values.groupBy(*by).agg(F.min(field).alias("a"), F.max(field).alias("b"))
    if zero_baseline:
        ends = ends.withColumn("a", F.least(F.lit(0.0), "a")).withColumn(
            "b", F.greatest(F.lit(0.0), "b"))
    flat = F.when(F.col("a") == 0, 1.0).otherwise(F.abs("a")) * 0.1
    margin = F.when(F.col("a") == F.col("b"), flat).otherwise(
        (F.col("b") - F.col("a")) * padding)
    low, high = F.col("a") - margin, F.col("b") + margin
    if bounded_percent:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(100.0), high)
    return ends.select(*by, F.coalesce(F.when(F.col("a").isNotNull(), low), F.lit(0.0)).alias("low"),
                       F.coalesce(F.when(F.col("b").isNotNull(), high), F.lit(1.0)).alias("high"))


def small_multiples(series: DataFrame, by: str) -> DataFrame:
    """The same monthly series for every member, with the domain shared by all panels."""
    bounds = value_domain(series, ["measure_id"])
    return series.join(bounds, "measure_id").select(
        "measure_id", F.col(by).alias("panel"), "month", "value", "low", "high")


def bullet_rows(actual: DataFrame, targets: DataFrame) -> DataFrame:
    """Actual against target per member, with attainment and its band."""
    rate = F.col("actual") / F.when(F.col("target") != 0, F.col("target"))
    return actual.join(targets, "name").select(
        "name", "actual", "target", (rate * 100).alias("attainment_pct"),
        F.when(rate >= 1, "met").when(rate >= 0.8, "near").when(rate.isNotNull(), "missed")
        .alias("band"))


def composition(series: DataFrame, by: str) -> DataFrame:
    """Share of every member in each month (100 % stack); also the penetration of one member."""
    totals = series.groupBy("measure_id", "month").agg(F.sum("value").alias("_total"))
    share = F.col("value") / F.when(F.col("_total") != 0, F.col("_total")) * 100
    return series.join(totals, ["measure_id", "month"]).select(
        "measure_id", "month", F.col(by).alias("name"), "value", share.alias("share"))


# Fields of a total that may become a headline number, in display order.
_HEADLINES = (("current", "auto"), ("change_pct", "signed_percent"), ("baseline", "auto"),
              ("change_abs", "signed_number"))


def headline_candidates(totals: DataFrame, measures: Sequence[Measure], n: int = 6) -> DataFrame:
    """First ``n`` finite headline paths: the primary measure, then the others as declared."""
    lead = [m for m in measures if m.primary] + [m for m in measures if not m.primary]
    pairs = [F.lit(x) for i, m in enumerate(lead) for x in (m.id, i)]
    position = F.try_element_at(F.create_map(*pairs), F.col("measure_id"))
    fields = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(field).alias("field"),
                                F.lit(shown).alias("format"), F.col(field).alias("value"))
                       for i, (field, shown) in enumerate(_HEADLINES)])
    paths = (totals.withColumn("_lead", position)
             .select("measure_id", "_lead", F.explode(fields).alias("f"))
             .where(F.col("f.value").isNotNull()))
    chosen = paths.orderBy("_lead", "f.slot").limit(n)
    place = F.row_number().over(W.orderBy("_lead", "f.slot"))  # at most n rows
    return chosen.select(
        place.alias("position"),
        F.concat_ws(".", F.lit("measure_results"), "measure_id", "f.field").alias("path"),
        F.col("f.format").alias("format"), F.col("f.value").alias("value"))


def slope_rows(rows: DataFrame, measures: Sequence[Measure], n: int = 8) -> DataFrame:
    """Top members by current value that have both sides, with the state of their move."""
    leads = top_n(rows, MEMBER_GROUP, [F.col("current").desc_nulls_last(), F.col("name").asc()], n)
    state = delta_state(F.col("baseline"), F.col("current"),
                        measure_attribute(measures, "direction"))
    return leads.where(F.col("current").isNotNull() & F.col("baseline").isNotNull()).select(
        "measure_id", "dimension", "name", "baseline", "current", state.alias("state"), "rank")
