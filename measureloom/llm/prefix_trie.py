"""Trie of conversation prefixes by van Emde Boas recursion.

Every sequence is cut at half the greatest depth. What is above the cut belongs to the upper trie, what
is below to the lower forest of its cut prefix, and both are tries of half the depth, cut again until
blocks hold one turn: one round per halving, for all tries of all conversations at once, and every
round works on rows keyed by (conversation, block), so that no conversation and no shared prefix meets
in one task. A cut prefix is named by a 128-bit digest: the name of the forest it lies in, joined with
the digest of the half block between, which the rounds upward made of blocks of half the size.

Totals of subtrees go up the same way: blocks double, and the total of each lower forest is grafted
onto the nodes between its cut and the top of the upper block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, small_enough, written
from .ranks import before, repeated

#: Conversation ids of one node that are joined into one piece before hashing.
PIECE = 4096
_NAME = ("n1", "n2")


def _placed() -> list[Column]:
    """Digest of a turn and of where it stands; a block's is their exclusive or."""
    return [F.xxhash64("d1", "d2", "pos").alias("n1"), F.xxhash64("pos", "d2", "d1").alias("n2")]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """Columns conv, pos (1 first, by turn, null turns first), d1 and d2 (digest of role and text), chars.

    Null roles and texts count as empty. Rows of equal turn follow their digests; equal rows are
    counted before they are numbered. Rows without a conversation are left out.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring("_d", at, 16), 16, -10).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("_d"),
        F.length(text).cast("long").alias("chars"))
    once = rows.groupBy("conv", "turn", "_d", "chars").agg(F.count(F.lit(1)).alias("_times"))
    placed = before(once, ["conv"], ["turn", "_d"], "_before", "_times")
    return repeated(placed, "_times", "_k").select(
        "conv", (F.col("_before") + F.col("_k") + 1).alias("pos"), half(1).alias("d1"), half(17).alias("d2"), "chars")


def named(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows with the name of the prefix that ends there (n1, n2) and of its parent (p1, p2).

    `sizes` holds the number of turns of each conversation (conv, size). Rounds upward digest blocks of
    1, 2, 4, … turns; rounds downward halve the blocks and name the forest of every lower half.
    """
    depth = sizes.agg(F.max("size")).first()[0] or 0
    up, size = {1: rows.select("conv", (F.col("pos") - 1).alias("start"), *_placed())}, 1
    while 2 * size < depth:
        wider = up[size].groupBy("conv", (F.col("start") - F.col("start") % (2 * size)).alias("start")).agg(
            F.bit_xor("n1").alias("n1"), F.bit_xor("n2").alias("n2"))
        size *= 2
        up[size] = written(wider)
    forests = sizes.where("size > 0").select(
        "conv", "size", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("p1"),
        F.lit(0).cast("long").alias("p2"))
    while size >= 1:
        below = forests.where(F.col("size") > F.col("start") + size)
        halves = up[size].select("conv", "start", *_NAME)
        lower = below.join(halves, ["conv", "start"]).select(
            "conv", "size", (F.col("start") + size).alias("start"),
            F.col("p1").bitwiseXOR(F.col("n1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("n2")).alias("p2"))
        forests = written(forests.unionByName(lower))
        size //= 2
    own = rows.select("conv", "pos", (F.col("pos") - 1).alias("start"), "chars", *_placed())
    return own.join(forests, ["conv", "start"]).select(
        "conv", "pos", "size", "chars", "p1", "p2", F.col("p1").bitwiseXOR(F.col("n1")).alias("n1"),
        F.col("p2").bitwiseXOR(F.col("n2")).alias("n2"))


def _grafted(nodes: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """Totals of every node's subtree: depth, n1, n2, n_leaves and saved_tokens.

    In round s the blocks have s turns and are about to have 2s: the roots of the lower forests are
    summed per cut node, and the sum goes to the nodes of the upper block on the way to the cut, found
    along the conversation that the cut node is called after. Cuts of large blocks are few and are
    broadcast; those of small blocks may be joined by shuffle, where a key has no more turns than the block.
    """
    totals = nodes.select(
        "depth", *_NAME, "parent_conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    size = 1
    while size < depth:
        tops = totals.where((F.col("depth") - 1) % (2 * size) == size)
        cuts = written(tops.groupBy((F.col("depth") - 1 - size).alias("start"), F.col("parent_conv_id").alias("conv")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        above = paths.where((F.col("pos") - 1) % (2 * size) < size).select(
            "conv", (F.col("pos") - 1 - (F.col("pos") - 1) % (2 * size)).alias("start"), F.col("pos").alias("depth"), *_NAME)
        grafts = above.join(small_enough(cuts), ["conv", "start"]).select(
            "depth", *_NAME, F.lit(None).cast("long").alias("parent_conv_id"), "n_leaves", "saved_tokens")
        totals = written(totals.unionByName(grafts).groupBy("depth", *_NAME).agg(
            F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens")))
        size *= 2
    return totals.drop("parent_conv_id")


def build(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and which conversation ends where.

    `rows` are turns as `turns` gives them, `convs` all conversations (conv), also those without turns.
    Nodes: depth, n1, n2 (name), conv_id (smallest member), parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens. Ends: conv, depth, n1, n2. Without conversations there is no
    node, not even a root.
    """
    rows = reliable(rows)
    counted = rows.groupBy("conv").agg(F.max("pos").alias("size"))
    sizes = reliable(convs.select("conv").distinct().join(counted, "conv", "left").select(
        "conv", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    depth = sizes.agg(F.max("size")).first()[0] or 0
    paths = written(named(rows, sizes))
    inner = paths.groupBy(F.col("pos").alias("depth"), *_NAME).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), "conv_id", "n_convs", zero.alias("chars"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    plain = written(inner.unionByName(root))
    children = plain.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"),
                                                F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    children = written(children)
    parents = children.join(plain.select("depth", *_NAME, "conv_id"), ["depth", *_NAME]).select(
        (F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"))
    nodes = written(plain.join(children, ["depth", *_NAME], "left").join(
        small_enough(parents), ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    totals = _grafted(nodes.where("depth > 0"), paths, depth)
    top = totals.where("depth = 1").agg(F.sum("n_leaves").alias("a"), F.sum("saved_tokens").alias("b")).select(
        zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), F.coalesce("a", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("b", zero).alias("saved_tokens"))
    whole = nodes.join(totals.unionByName(top), ["depth", *_NAME])
    ends = paths.where("pos = size").select("conv", F.col("pos").alias("depth"), *_NAME).unionByName(
        sizes.where("size = 0").select("conv", zero.alias("depth"), zero.alias("n1"), zero.alias("n2")))
    return whole.select("depth", *_NAME, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens"), ends


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node from its pieces in order; only the running hash is held."""
    node, running = None, None

    def done():
        return pa.RecordBatch.from_pydict({"depth": [node[0]], "n1": [node[1]], "n2": [node[2]], "sha": [running.hexdigest()]})

    for batch in batches:
        for depth, n1, n2, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "n1", "n2", "ids")), strict=True):
            if (depth, n1, n2) == node:
                running.update(b",")
            else:
                if node is not None:
                    yield done()
                node, running = (depth, n1, n2), hashlib.sha256()
            running.update(ids.encode())
    if node is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and comma-joined: depth, n1, n2, sha.

    Ids are joined in pieces of a range of PIECE numbers first; the pieces of a node then pass one
    running hash, which by its nature takes them in turn.
    """
    pieces = ends.groupBy("depth", *_NAME, F.floor(F.col("conv") / PIECE).alias("piece")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    lined = pieces.repartition("depth", *_NAME).sortWithinPartitions("depth", *_NAME, "piece").select("depth", *_NAME, "ids")
    return lined.mapInArrow(_hashed, "depth long, n1 long, n2 long, sha string")


def crossed(conversations: DataFrame, every: int = 100, most: int = 6, conv_col: str = "conv_id", **columns: str
            ) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin as another: rows as of `turns`, and all conversations.

    Conversation c takes the first h turns of conversation c - c % every, as far as there are that many,
    and its own turns after its first h, with h the unsigned CRC-32 of the decimal c, modulo `most`.
    """
    rows = reliable(turns(conversations, conv_col, **columns))
    convs = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv")).distinct()
    plan = reliable(convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("lead"),
                                 (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")))
    first = rows.where(F.col("pos") < most)
    led = plan.join(first.withColumnRenamed("conv", "lead"), "lead").where("pos <= h").select(*rows.columns)
    taken = plan.join(first.groupBy(F.col("conv").alias("lead")).agg(F.max("pos").alias("held")), "lead", "left").select(
        "conv", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("skip"))
    own = rows.join(small_enough(taken), "conv").where("pos > h").withColumn("pos", F.col("skip") + F.col("pos") - F.col("h"))
    return led.unionByName(own.select(*rows.columns)), convs
