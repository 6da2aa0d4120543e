"""Mixing of sources to target weights by temperature, realised as budgeted block permutations.

Weights are token shares raised to an exponent and normalised. The exponent is bisected until the
weights reach a target entropy, or until no source has to be repeated more often than allowed. Each
source then gets its part of the token budget: whole passes over the source, and one last part. Every
pass reads the blocks of the source in an order of its own, and the documents of a block in an order
of their own; the last part ends inside one block.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import reliable, small_enough

#: Tokens a block should hold: what one task lines up at ease.
BLOCK_TOKENS = 1_000_000
#: Sources beyond this many do not fit the plan, which is made on the driver from one row per source.
MAX_SOURCES = 100_000


def tokens_of(text: Column) -> Column:
    """White-space separated words; null and blank texts have none."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.size(words)).otherwise(0).cast("long")


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised shares raised to the exponent; sources without tokens get none."""
    total = sum(tokens.values())
    raised = {s: (t / total) ** exponent if t else 0.0 for s, t in sorted(tokens.items(), key=lambda x: str(x[0]))}
    norm = math.fsum(raised.values())
    return {s: v / norm for s, v in raised.items()} if norm else raised


def entropy(w: dict) -> float:
    return -math.fsum(v * math.log(v) for v in w.values() if v > 0)


def bisect_exponent(tokens: dict, target_entropy: float | None = None, max_repeats: float | None = None,
                    budget: int | None = None, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] whose weights meet the target.

    ``target_entropy`` is a share of the highest possible entropy, log of the sources with tokens: the
    result is the exponent whose entropy equals it, clipped to 0 or 1. ``max_repeats`` bounds budget
    times weight over tokens for every source; at exponent 1 every source is repeated budget / total
    times, so lower bounds than that give 1. With both, the repetition limit wins where they differ.
    """
    present = {s: t for s, t in tokens.items() if t}
    if len(present) < 2:
        return 1.0

    def too_flat(exponent: float) -> bool:
        w = weights(present, exponent)
        flat = target_entropy is not None and entropy(w) > target_entropy * math.log(len(present))
        return flat or (max_repeats is not None and max(
            (budget or sum(present.values())) * w[s] / t for s, t in present.items()) > max_repeats)

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def budgets(tokens: dict, w: dict, budget: int) -> dict:
    """Whole tokens per source that add up to the budget: largest remainders get the rest, then names."""
    whole = {s: math.floor(budget * v) for s, v in w.items()}
    rest = budget - sum(whole.values()) if any(w.values()) else 0
    for s in sorted((s for s in w if tokens[s]), key=lambda s: (whole[s] - budget * w[s], str(s)))[:rest]:
        whole[s] += 1
    return whole


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = 0.98,
        max_repeats: float | None = 4.0, seed: int = 17, block_tokens: int = BLOCK_TOKENS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn documents: all columns of the input, then n_tokens, epoch, block and place.

    One row per time a document is drawn; ``epoch`` counts the passes of its source from 0, ``block``
    is the rank of its block in the pass, ``place`` sorts the documents of a block. ``budget`` defaults to the tokens of the input. A source draws documents until its budget is
    reached, so that its last document may exceed it. Null is a source like others; documents without
    tokens are drawn with their block and cost nothing; repeated rows are drawn each; an empty table
    gives an empty result. Columns of the input named like the four are replaced.
    """
    work = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block", "place")]
    keyed = docs.select(*work).withColumn("n_tokens", tokens_of(F.col(text_col))).withColumn(
        "_h", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    # One light pass over source, size and hash makes the plan; texts are never shuffled for it.
    light = reliable(keyed.select(F.col(source_col).alias("_s"), "_h", "n_tokens"))
    per = light.groupBy("_s").agg(F.sum("n_tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["_s"]: r["t"] for r in per}
    goal = budget if budget is not None else sum(tokens.values())
    parts = budgets(tokens, weights(tokens, bisect_exponent(tokens, target_entropy, max_repeats, goal)), goal)
    # As an Arrow table: a list of rows would start Python workers on the executors to unpack it.
    columns = zip(*[(s, int(parts[s]), int(tokens[s]), max(1, round(tokens[s] / block_tokens))) for s in tokens], strict=True)
    kinds = [to_arrow_type(docs.schema[source_col].dataType), *[pa.int64()] * 3]
    plan = pa.table([pa.array(c, k) for c, k in zip(tokens and columns or [[]] * 4, kinds, strict=True)],
                    ["_s", "_part", "_total", "_blocks"])
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan))

    def in_blocks(df: DataFrame, source: str) -> DataFrame:
        joined = df.join(plan.withColumnRenamed("_s", "_of"), F.col(source).eqNullSafe(F.col("_of")))
        return joined.drop("_of").withColumn("_b", F.pmod(F.xxhash64("_h", F.lit(1)), F.col("_blocks")))

    # Blocks: one row each and pass, with their rank in the pass and the tokens before them.
    blocked = in_blocks(light, "_s")
    sums = blocked.groupBy("_s", "_b").agg(F.sum("n_tokens").alias("_t"), *[F.first(c).alias(c) for c in ("_part", "_total")])
    passes = sums.where("_part > 0").withColumn(
        "epoch", F.explode(F.expr("sequence(0L, cast(ceil(_part / _total) as bigint) - 1)")))
    lined = Window.partitionBy("_s", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "_b"), "_b")
    placed = passes.select(
        F.col("_s").alias("_ps"), F.col("_b").alias("_pb"), "epoch", "_t",
        (F.row_number().over(lined) - 1).cast("long").alias("block"),
        (F.sum("_t").over(lined) - F.col("_t")).alias("_begin"),
        F.least(F.col("_total"), F.col("_part") - F.col("epoch") * F.col("_total")).alias("_left"))
    placed = placed.where("_begin < _left").withColumn("_cut", F.col("_begin") + F.col("_t") > F.col("_left"))
    placed = reliable(placed)

    # The last block of a source is cut: its documents are lined up, all other blocks are drawn whole.
    place = F.xxhash64(F.lit(seed), "epoch", "_h")
    same = F.col("_s").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb"))
    cut = small_enough(placed.where("_cut"), MAX_SOURCES)
    inside = Window.partitionBy("_s", "_b", "epoch").orderBy(place, "_h")
    ends = blocked.join(cut, same).groupBy("_s", "_b", "epoch", "_h", "_begin", "_left").agg(
        F.sum("n_tokens").alias("n")).withColumn("_at", F.col("_begin") + F.sum("n").over(inside) - F.col("n"))
    last = small_enough(reliable(ends.where("_at < _left").select(
        F.col("_s").alias("_ls"), F.col("_h").alias("_lh"), F.col("epoch").alias("_le"))))
    drawn = in_blocks(keyed.withColumn("_s", F.col(source_col)), "_s").join(small_enough(placed), same)
    drawn = drawn.join(last, F.col("_cut") & (F.col("_h") == F.col("_lh")) & (F.col("epoch") == F.col("_le"))
                       & F.col("_s").eqNullSafe(F.col("_ls")), "left")
    return drawn.where(~F.col("_cut") | F.col("_lh").isNotNull()).select(
        *work, "n_tokens", "epoch", "block", place.alias("place"))
