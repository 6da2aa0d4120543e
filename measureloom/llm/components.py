"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links in one file of a round.
FILE_ROWS = 250_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) per node of the links; nodes reach each other when their roots agree.

    Every round each node moves to the neighbour, or itself, of lowest priority, a hash that changes
    with the round, and links are renamed to where their ends moved; those that became loops go. A
    constant share of the nodes disappears per round whatever the shape, so stars, chains and dense
    groups all take logarithmically many rounds. Minima combine before the shuffle; the hub of a star
    is a skewed join key that adaptive execution splits. Null ends and loops are dropped; repeated
    links count once; no links give no rows.
    """
    links = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(
        "a < b").distinct())
    # A few rounds over a small table should not write hundreds of tiny files each.
    files = max(8, links.count() // FILE_ROWS)
    mapping, step = None, 0
    while mapping is None or not links.isEmpty():
        step += 1

        def ranked(column: str, step: int = step):
            return F.struct(F.xxhash64(F.col(column), F.lit(step)).alias("h"), F.col(column).alias("u"))

        ends = links.select(F.col("a").alias("v"), F.least(ranked("a"), ranked("b")).alias("r")).unionAll(
            links.select(F.col("b").alias("v"), F.least(ranked("a"), ranked("b")).alias("r")))
        step_of = written(ends.groupBy("v").agg(F.min("r").alias("r")).select("v", F.col("r.u").alias("m")), files)
        # Two steps at once: to where the neighbour itself moves.
        onward = step_of.select(F.col("v").alias("m"), F.col("m").alias("next"))
        low = written(step_of.join(onward, "m").select("v", F.col("next").alias("m")), files)
        moved = low.select(F.col("v").alias("root"), "m")
        mapping = written(low.select(F.col("v").alias("node"), F.col("m").alias("root")) if mapping is None
                           else mapping.join(moved, "root", "left").select(
                               "node", F.coalesce("m", "root").alias("root")), files)
        left = low.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        right = low.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        links = written(links.join(left, "a").join(right, "b").select(
            F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a < b").distinct(), files)
    return mapping
