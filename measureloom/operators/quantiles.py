"""Exact interpolated quantiles of groups of any size.

A built-in exact percentile keeps every distinct value of a group in one task. Here the wanted ranks
are located by counting: rows are counted per logarithmic bucket where they are read, which ranks
fall into which bucket is known from the counters, and a rank at the end of its bucket, or in a
bucket of one value, is settled by the counters alone. Only rows of buckets that hold an open rank
are read again, and only those are shuffled, as (value, count) pairs; linear slices of the bucket,
then the values of the hit slice, find the rest. Windows order counters, not data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measureloom.session import cut_lineage

_PER_OCTAVE = 128        # coarse buckets per doubling of the magnitude
_SLICES = 1 << 17        # linear slices of one coarse bucket
_LIFT = 1100 * _PER_OCTAVE


def bucket(v: Column) -> Column:
    """Integer that never decreases when ``v`` increases.

    It is declared non-null, so that joins on it add no null filter and all steps can share one
    exchange of the values.
    """
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1024.0)) * _PER_OCTAVE) + _LIFT
    return F.coalesce(F.when(v > 0, size).when(v < 0, -size).cast("int"), F.lit(0))


def slice_of(v: Column, low: Column, high: Column) -> Column:
    """Linear slice of ``v`` between the ends of its bucket; never decreases with ``v``."""
    width = high - low
    step = F.floor((v - low) / width * _SLICES)
    return F.when((width > 0) & (width < float("inf")), F.least(step, F.lit(_SLICES - 1))
                  ).otherwise(F.when(v > low, _SLICES - 1).otherwise(0)).cast("int")


def _hits(counted: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Keep the rows whose running count covers a wanted rank; ranks become relative to the row."""
    w = W.partitionBy(*by).orderBy(order)
    run = counted.withColumn("_to", F.sum("_n").over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    start = F.col("_to") - F.col("_n")
    inside = F.filter("_ranks", lambda r: (r["left"] >= start) & (r["left"] < F.col("_to")))
    moved = F.transform(inside, lambda r: F.struct(
        r["rank"].alias("rank"), (r["left"] - start).alias("left")))
    return run.withColumn("_ranks", moved).where(F.size("_ranks") > 0).drop("_to")


def ranks_of(total: Column, probs: Sequence[float]) -> Column:
    """The distinct ranks that the quantiles of so many values interpolate between."""
    ends = []
    for p in probs:
        at = (total - 1) * F.lit(float(p))
        ends += [F.floor(at), F.ceil(at)]
    return F.transform(F.array_distinct(F.array(*ends)), lambda r: F.struct(r.alias("rank"), r.alias("left")))


def located(counters: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The buckets that hold wanted ranks, from counters (by, _b, _n, _low, _high).

    Columns: by, _b, _low, _high, _total, _known (ranks with their value) and _ranks (open ranks, as
    places within the bucket).
    """
    whole = W.partitionBy(*by)
    found = counters.withColumn("_total", F.sum("_n").over(whole))
    found = _hits(found.withColumn("_ranks", ranks_of(F.col("_total"), probs)), by, "_b")
    one, first, last = F.col("_low") == F.col("_high"), F.lit(0), F.col("_n") - 1

    def settled(r: Column) -> Column:
        return one | (r["left"] == first) | (r["left"] == last)

    known = F.transform(F.filter("_ranks", settled), lambda r: F.struct(
        r["rank"].alias("rank"), F.when(one | (r["left"] == first), F.col("_low")).otherwise(F.col("_high")).alias("value")))
    return found.select(*by, "_b", "_low", "_high", "_total", known.alias("_known"),
                        F.filter("_ranks", lambda r: ~settled(r)).alias("_ranks"))


#: Open buckets that may be sent to every task, some 100 bytes each.
MAX_SENT = 200_000


def sent(hits: DataFrame, by: Sequence[str]) -> tuple[int, DataFrame | None]:
    """How many buckets are open, and the buckets (by, _b) marked for broadcast if MAX_SENT at most."""
    wanted = hits.where(F.size("_ranks") > 0).select(*by, "_b").distinct()
    count = wanted.count()
    return count, F.broadcast(wanted) if count <= MAX_SENT else None


def open_values(pairs: DataFrame, by: Sequence[str], hits: DataFrame) -> DataFrame:
    """(by, _total, _rank, _v): values of the open ranks of ``hits``, from pairs (by, _b, _v, _c).

    Keys must not be null. Values of other buckets do no harm.
    """
    hits = hits.where(F.size("_ranks") > 0).drop("_known")
    sliced = (pairs.join(hits, [*by, "_b"])
              .withColumn("_s", slice_of(F.col("_v"), F.col("_low"), F.col("_high")))
              .groupBy(*by, "_b", "_s")
              .agg(F.sum("_c").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_upto"),
                   F.first("_ranks").alias("_ranks"), F.first("_total").alias("_total")))
    sliced = _hits(sliced, [*by, "_b"], "_s").select(*by, "_b", "_s", "_from", "_upto", "_ranks", "_total")
    fine = (pairs.join(sliced, [*by, "_b"]).where(F.col("_v").between(F.col("_from"), F.col("_upto")))
            .select(*by, "_b", "_s", F.col("_c").alias("_n"), "_v", "_ranks", "_total"))
    return _hits(fine, [*by, "_b", "_s"], "_v").select(*by, "_total", F.explode("_ranks.rank").alias("_rank"), "_v")


def known_values(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _total, _rank, _v): values that the counters settle."""
    return hits.select(*by, "_total", F.explode("_known").alias("k")).select(
        *by, "_total", F.col("k.rank").alias("_rank"), F.col("k.value").alias("_v"))


def interpolated(found: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One column per quantile from the values at its ranks."""
    out = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low = F.max(F.when(F.col("_rank") == F.floor(at), F.col("_v")))
        high = F.max(F.when(F.col("_rank") == F.ceil(at), F.col("_v")))
        out.append((low + (high - low) * F.first(at - F.floor(at))).alias(name))
    return found.groupBy(*by).agg(*out)


def values_at(counters: DataFrame, rows: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles per key from bucket counters and the rows (by, _b, _v) they were counted from.

    Open buckets are sent to the rows as a filter while they are few; with very many, all rows are
    reduced to pairs of value and count, and joined.
    """
    hits = cut_lineage(located(counters, by, list(probs.values())))
    found = known_values(hits, by)
    count, few = sent(hits, by)
    if count:
        rows = rows if few is None else rows.join(few, [*by, "_b"], "left_semi")
        pairs = rows.groupBy(*by, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
        found = found.unionByName(open_values(pairs, by, hits))
    return interpolated(found, by, probs)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    summary: bool = False) -> DataFrame:
    """Interpolated quantiles of ``value`` per key; one output column per name in ``probs``.

    Null values are ignored, keys without any value are absent. ``summary`` adds ``count`` and
    ``mean`` from the same scan. The counters are made when this is called; ``df`` is read once more
    where they leave a rank open.
    """
    keys = list(keys)
    safe = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(s)
             for k, s in zip(keys, safe)] or [F.lit("").alias("_k0")]
    rows = df.select(*named, *[F.col(k) for k in keys], (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where(
        F.col("_v").isNotNull()).withColumn("_b", bucket(F.col("_v")))
    counters = cut_lineage(rows.groupBy(*safe, *keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        F.sum("_v").alias("_sum")))
    result = values_at(counters.drop("_sum", *keys), rows.drop(*keys), safe, probs)
    extra = {"count": F.sum("_n"), "mean": F.sum("_sum") / F.sum("_n")} if summary else {}
    whole = counters.groupBy(*safe, *keys).agg(F.count(F.lit(1)).alias("_buckets"), *[c.alias(n) for n, c in extra.items()])
    return whole.join(result, safe).select(*keys, *probs, *extra)
