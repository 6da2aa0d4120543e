"""Direction, state and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def favorable(delta: Column, direction: Column) -> Column:
    """True when a change goes the good way; no change is good; neutral measures give null."""
    return (
        F.when(delta.isNull() | (direction == "neutral"), F.lit(None).cast("boolean"))
        .when(delta == 0, F.lit(True))
        .when(direction == "higher_is_better", delta > 0)
        .otherwise(delta < 0))


def delta_state(before: Column, after: Column, direction: Column) -> Column:
    """unknown, unchanged, neutral, favorable or unfavorable."""
    better = F.when(direction == "higher_is_better", after > before).otherwise(after < before)
    return (
        F.when(before.isNull() | after.isNull(), "unknown")
        .when(before == after, "unchanged")
        .when(direction == "neutral", "neutral")
        .when(better, "favorable")
        .otherwise("unfavorable"))


def slug(c: Column, fallback: str = "measure") -> Column:
    """ASCII identifier of a label; the fallback when nothing is left."""
    kept = F.lower(F.regexp_replace(
        F.regexp_replace(c, r"[^0-9A-Za-z_\-]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def truncated(c: Column, longest: int = 18) -> Column:
    """Label of at most ``longest`` characters, cut with an ellipsis."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    cut = F.concat(F.substring(text, 1, max(1, longest - 1)), F.lit("…"))
    return F.when(F.char_length(text) > longest, cut).otherwise(text)


def guarded_change_pct(current: Column, baseline: Column) -> Column:
    """Percent change; null on a null or zero baseline."""
    return (current / F.when(baseline != 0, baseline) - 1) * 100
