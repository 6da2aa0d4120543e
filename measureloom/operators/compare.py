"""Compare the current period with its baseline: totals, members, bridges, year over year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measureloom.contract import TOTAL, Measure, Thresholds
from measureloom.functions import cleaning
from measureloom.functions.labels import favorable, guarded_change_pct
from measureloom.operators.scope import BASE, CURRENT, Lock, tag


def measure_attribute(measures: Sequence[Measure], attribute: str,
                      by: Column | None = None) -> Column:
    """Literal lookup of a contract attribute by measure id."""
    pairs = [F.lit(x) for m in measures for x in (m.id, getattr(m, attribute))]
    return F.try_element_at(F.create_map(*pairs), F.col("measure_id") if by is None else by)


def measure_frame(spark: SparkSession, measures: Sequence[Measure]) -> DataFrame:
    """The measure contract as rows."""
    schema = ("measure_id string, label string, unit string, direction string, additivity string, "
              "aggregation string, semantic_type string, primary boolean")
    return spark.createDataFrame(
        [(m.id, m.title, m.unit, m.direction, m.additivity, m.aggregation, m.semantic_type,
          m.primary) for m in measures], schema)


def total_comparison(facts: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """measure_id, current, baseline, change_abs, change_pct, favorable of the grand totals."""
    delta = F.col("current") - F.col("baseline")
    return facts.where(F.col("dimension") == TOTAL).select(
        "measure_id", "current", "baseline", delta.alias("change_abs"),
        guarded_change_pct(F.col("current"), F.col("baseline")).alias("change_pct"),
        favorable(delta, measure_attribute(measures, "direction")).alias("favorable"))


def _totals(facts: DataFrame) -> DataFrame:
    at_total = F.col("dimension") == TOTAL
    return facts.groupBy("measure_id").agg(
        F.max(F.when(at_total, F.col("current"))).alias("total_current"),
        F.max(F.when(at_total, F.col("baseline"))).alias("total_base"))


def _signs(facts: DataFrame) -> DataFrame:
    lowest = F.least(F.coalesce("current", F.lit(0.0)), F.coalesce("baseline", F.lit(0.0)))
    return facts.groupBy("measure_id", "dimension").agg(
        (F.min(lowest) < 0).alias("has_negative_part"),
        (F.max("dimension") != TOTAL).alias("is_member"))


def member_comparison(facts: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Member rows with share, change, delta, direction and contribution.

    The sides were aligned by conditional aggregation, so members of one side only are already
    here. Totals and sign guards are aggregates of the same facts (a few rows per measure and
    dimension) joined back, never a window over all members. The facts are read three times: hand
    in a written copy (``cut_lineage``) when they are expensive.
    """
    additive = measure_attribute(measures, "additivity") == "additive"
    current, baseline = F.col("current"), F.col("baseline")
    total = F.when(F.col("total_current") != 0, F.col("total_current"))
    share = F.when(additive & ~F.col("has_negative_part"), current / total * 100)
    base_total = F.when(F.col("total_base") != 0, F.col("total_base"))
    base_share = F.when(additive & ~F.col("has_negative_part"), baseline / base_total * 100)
    delta = current - baseline
    # One row per declared measure and dimension: bounded by the contract, so safe to broadcast.
    rows = (facts.join(F.broadcast(_signs(facts).where("is_member")), ["measure_id", "dimension"])
            .join(F.broadcast(_totals(facts)), ["measure_id"]))
    return rows.select(
        "measure_id", "dimension", "name", "current", "baseline", "in_current", "in_base",
        share.alias("share"), base_share.alias("base_share"),
        guarded_change_pct(current, baseline).alias("change_pct"), delta.alias("delta"),
        favorable(delta, measure_attribute(measures, "direction")).alias("favorable"),
        F.when(additive, delta / base_total * 100).alias("contribution_pp"),
        "has_negative_part")


def share_shift(rows: DataFrame, threshold_pp: float = 1.5) -> DataFrame:
    """Share movement in points; ``material`` marks moves of at least the threshold."""
    shift = F.col("share") - F.col("base_share")
    return rows.select("measure_id", "dimension", "name", "share", "base_share",
                       shift.alias("share_shift_pp"),
                       (F.abs(shift) >= threshold_pp).alias("material"))


def price_volume_mix(df: DataFrame, amount: Measure, quantity: Measure, lock: Lock, time: str,
                     thresholds: Thresholds | None = None, timezone: str | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Bridge from baseline to current amount: volume effect and price-with-mix effect.

    Quantities count only on rows whose amount is readable. The result is BLOCKED when too many
    quantities are unreadable or when any sum is not positive.
    """
    limits = thresholds or Thresholds()
    tagged = tag(df, lock, time, timezone)
    rows = tagged.select(
        *[cleaning.member(F.col(f"`{d}`")).alias(d) for d in by], CURRENT, BASE,
        cleaning.row_value(tagged, amount).alias("v"),
        cleaning.number(tagged, quantity.field).alias("q"),
        F.col(f"`{quantity.field}`").isNotNull().alias("q_filled"))
    priced = F.col("v").isNotNull()
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(F.col(CURRENT), F.col("v"))).alias("v1"),
        F.sum(F.when(F.col(BASE), F.col("v"))).alias("v0"),
        F.coalesce(F.sum(F.when(F.col(CURRENT) & priced, F.col("q"))), F.lit(0.0)).alias("q1"),
        F.coalesce(F.sum(F.when(F.col(BASE) & priced, F.col("q"))), F.lit(0.0)).alias("q0"),
        F.count_if(F.col("q_filled") & F.col("q").isNull()).alias("bad"),
        F.count_if(F.col("q_filled")).alias("filled"))
    p1 = F.col("v1") / F.when(F.col("q1") > 0, F.col("q1"))
    p0 = F.col("v0") / F.when(F.col("q0") > 0, F.col("q0"))
    volume = (F.col("q1") - F.col("q0")) * p0
    bad_pct = F.coalesce(F.col("bad") / F.when(F.col("filled") > 0, F.col("filled")) * 100,
                         F.lit(0.0))
    positive = ((F.col("q1") > 0) & (F.col("q0") > 0) & (F.col("v1") > 0) & (F.col("v0") > 0))
    bridge = sums.select(
        *by, F.col("v0").alias("base_value"), F.col("v1").alias("current_value"),
        F.col("q0").alias("base_qty"), F.col("q1").alias("current_qty"),
        p0.alias("base_price"), p1.alias("current_price"),
        volume.alias("volume_effect"),
        (F.col("v1") - F.col("v0") - volume).alias("price_mix_effect"),
        ((F.col("q1") / F.when(F.col("q0") > 0, F.col("q0")) - 1) * 100).alias("qty_change_pct"),
        ((p1 / F.when(p0 > 0, p0) - 1) * 100).alias("price_change_pct"),
        bad_pct.alias("qty_parse_error_pct"),
        F.when((bad_pct <= limits.qty_parse_block_pct) & F.coalesce(positive, F.lit(False)), "OK")
        .otherwise("BLOCKED").alias("status"))
    return bridge


def pvm_quadrant(bridge: DataFrame) -> DataFrame:
    """Reading of a bridge: did volume and price each go up or down (fixed wording)."""
    qty, price = F.col("qty_change_pct"), F.col("price_change_pct")
    quadrant = (F.when((qty >= 0) & (price >= 0), "量价齐升").when(qty >= 0, "量增价减")
                .when(price >= 0, "量减价升").otherwise("量价齐跌"))
    usable = (F.col("status") == "OK") & qty.isNotNull() & price.isNotNull()
    return bridge.withColumn("quadrant", F.when(usable, quadrant))


def yoy_series(series: DataFrame, by: Sequence[str] = ("measure_id",),
               digits: int | None = None) -> DataFrame:
    """Monthly year-over-year percent from a (…, month, value) series.

    A month counts only when the same month one year earlier exists with a positive value and the
    current value is not negative. One window over the months of a series, no self join.
    """
    month = F.col("month")
    w = W.partitionBy(*by, F.month(month)).orderBy(F.year(month))
    prior_month, prior = F.lag(month).over(w), F.lag("value").over(w)
    pairs = series.withColumn("prior", F.when(
        prior_month == F.add_months(month, -12), prior))
    change = (F.col("value") / F.col("prior") - 1) * 100
    if digits is not None:
        change = F.bround(change, digits)
    return pairs.where((F.col("prior") > 0) & (F.col("value") >= 0)).select(
        *by, "month", change.alias("value"))
