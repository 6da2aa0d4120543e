"""Near-duplicate embeddings by sorted projection passes.

Every pass draws random hyperplanes, writes the side of each as one bit of a key, and orders all
vectors of a label by that key; vectors at a small angle share long beginnings and come to lie close.
Each vector is compared with a bounded window of its successors. The window covers all vectors that
share so many first bits with a vector, which bounds how likely a link of it is missed in all passes.
Vectors for which that is not unlikely lie in crowds, and are compared with all others in crowds of
their label, blocks against blocks; the number of passes grows with the largest label. Verified pairs of all passes are
united into components; the direct links of a vector are then counted exactly within its component,
in blocks of bounded size. All passes are one shuffle: a range partitioning by pass, label and key, in
which even equal keys may be split, with the edges of partitions compared in a second step.

Equal vectors of a label are one vector with a weight, so that a third of all rows being the same
vector costs nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable
from .components import components

PASSES, WINDOW, BITS = 12, 24, 48
#: Passes are made until a vector of an even label misses a link at the threshold with EVEN at most, and
#: MOST_PASSES at most; a vector that may miss one with more than MISS is compared in blocks of CROWD.
EVEN, MISS, MOST_PASSES, CROWD = 1e-7, 1e-5, 48, 1024
#: Rows of a range partition in the passes, and vectors of a block in counting.
ROWS, BLOCK = 20_000, 256


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and bytes of the vectors that may link; null for others."""
    for batch in batches:
        keys, raw = [], []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            key = data = None
            if label is not None and v and None not in v:
                x = np.array(v, np.float64)
                with np.errstate(over="ignore"):
                    norm = np.sqrt((x * x).sum())
                if np.isfinite(x).all() and norm > 0:
                    if not np.isfinite(norm) or norm < 1e-150:
                        x = x / np.abs(x).max()
                    data = x.tobytes()
                    key = int(np.uint64(xxhash.xxh64_intdigest(repr(label).encode() + data)).view(np.int64))
            keys.append(key)
            raw.append(data)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([repr(x) for x in batch.column(1).to_pylist()]), pa.array(keys, pa.int64()),
             pa.array(raw, pa.binary())], ["id", "label", "vid", "vec"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(2).to_pylist()
            size = np.array([len(r) // 8 for r in raw])
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * BITS))
                side = (_unit([raw[i] for i in at]) @ planes[d] >= 0).reshape(len(at), passes, BITS)
                key = side.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                part = batch.take(pa.array(at))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), part.column(1), pa.array(np.full(len(at), d, np.int32)),
                         pa.array(key[:, p]), part.column(0), part.column(2)],
                        ["pass", "label", "size", "key", "vid", "vec"])

    return run


def _compared(group: np.ndarray, vid: np.ndarray, vec: np.ndarray, window: int, threshold: float):
    """Edges of a spanning forest of the verified pairs among rows at most ``window`` apart."""
    n = len(vid)
    a, b = [], []
    for step in range(1, min(window, n - 1) + 1):
        good = group[:-step] == group[step:]
        good &= np.einsum("ij,ij->i", vec[:-step], vec[step:]) >= threshold
        at = np.flatnonzero(good)
        a.append(at)
        b.append(at + step)
    a = np.concatenate([np.zeros(0, np.int64), *a])
    b = np.concatenate([np.zeros(0, np.int64), *b])
    return _forest(vid, a, b)


def _forest(vid: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Edges of a spanning forest of pairs of positions."""
    n = len(vid)
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(root != np.arange(n))
    return vid[linked], vid[root[linked]]


def _groups(batch) -> np.ndarray:
    names = [f"{p} {s} {g}" for p, s, g in zip(batch.column("pass").to_pylist(), batch.column("size").to_pylist(),
                                               batch.column("label").to_pylist(), strict=True)]
    return np.array(names, dtype=object)


def _links_of(table: pa.Table, window: int, threshold: float):
    """Edges among the rows of a sorted table, vectors of one dimension at a time."""
    size = table.column("size").to_numpy()
    group, vid = _groups(table), table.column("vid").to_numpy()
    raw = table.column("vec").to_pylist()
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield _compared(group[at], vid[at], _unit([raw[i] for i in at]), window, threshold)


EDGES = "edge int, late int, pass int, label string, size int, key bigint, vid bigint, vec binary, a bigint, b bigint, miss double"


def same_side(threshold: float) -> float:
    """Chance that a random hyperplane has two vectors at the threshold on one side."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


_STEPS = np.linspace(0, 8, 4001)
_TAIL = np.array([math.erfc(z / math.sqrt(2)) / 2 for z in _STEPS])


def _staying(vec: np.ndarray, planes: np.ndarray, threshold: float) -> np.ndarray:
    """Log of the chance that a vector at the threshold, in any direction, shares the first 0 to BITS bits.

    The distance to each plane counts: planes that split a crowd run through it, and part its links too.
    """
    near = np.abs(vec @ planes)
    beside = np.sqrt(np.maximum((planes * planes).sum(0) - near * near, 1e-30))
    slope = threshold / math.sqrt(max(1e-12, 1 - threshold * threshold)) * math.sqrt(max(1, vec.shape[1] - 1))
    part = np.interp(np.maximum(slope, 0.0) * near / beside, _STEPS, _TAIL)
    return np.concatenate([np.zeros((len(vec), 1)), np.cumsum(np.log1p(-part), axis=1)], axis=1).astype(np.float32)


def _misses(group: np.ndarray, key: np.ndarray, staying: np.ndarray, window: int) -> np.ndarray:
    """Log of the chance that the pass misses a link at the threshold, for each row of a sorted partition.

    A vector finds all that share more first bits with it than the first row beyond its window does.
    Rows whose group may go on beyond the partition count as missing.
    """
    n = len(key)
    name, bits = np.unique(group, return_inverse=True)[1], np.zeros(n, np.int64)
    for far in (np.arange(n) + window + 1, np.arange(n) - window - 1):
        inside = np.clip(far, 0, n - 1)
        # frexp has the length of a number below 2 ** 53, thus where keys begin to differ.
        shared = BITS - np.frexp((key ^ key[inside]).astype(float))[1]
        shared = np.where(name == name[inside], np.where(inside == far, shared + 1, BITS + 1), 0)
        bits = np.maximum(bits, shared)
    found = np.where(bits > BITS, 0.0, np.exp(staying[np.arange(n), np.minimum(bits, BITS)].astype(float)))
    return np.log(np.maximum(1 - found, 1e-30))


def _windows(window: int, threshold: float, passes: int, seed: int):
    """Within one partition: edges, the rows at its two ends for the step across partitions, and what it may miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, tail, first = TaskContext.get().partitionId(), None, None

        def rows(table: pa.Table, edge: int, late: int) -> Iterator[pa.RecordBatch]:
            n = table.num_rows
            whole = pa.table({"edge": pa.array(np.full(n, edge, np.int32)), "late": pa.array(np.full(n, late, np.int32)),
                              **{c: table.column(c) for c in table.column_names},
                              "a": pa.nulls(n, pa.int64()), "b": pa.nulls(n, pa.int64()), "miss": pa.nulls(n, pa.float64())})
            yield from whole.combine_chunks().to_batches()

        names, seen, planes = [c.split()[0] for c in EDGES.split(", ")], [], {}

        def chances(table: pa.Table) -> np.ndarray:
            out, raw = np.zeros((table.num_rows, BITS + 1), np.float32), table.column("vec").to_pylist()
            which = np.stack([table.column("pass").to_numpy(), table.column("size").to_numpy()], 1)
            for p, d in np.unique(which, axis=0).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * BITS))
                at = np.flatnonzero((which == (p, d)).all(1))
                out[at] = _staying(_unit([raw[i] for i in at]), planes[d][:, p * BITS:(p + 1) * BITS], threshold)
            return out

        for batch in batches:
            now = pa.Table.from_batches([batch])
            seen.append((_groups(now), now.column("key").to_numpy(), now.column("vid").to_numpy(), chances(now)))
            if first is None:
                first = now.slice(0, window)
                yield from rows(first, here, 1)
            elif first.num_rows < window:
                extra = now.slice(0, window - first.num_rows)
                first = pa.concat_tables([first, extra])
                yield from rows(extra, here, 1)
            joined = now if tail is None else pa.concat_tables([tail, now])
            for a, b in _links_of(joined, window, threshold):
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                     pa.array(a), pa.array(b), pa.nulls(n, pa.float64())], names)
            tail = joined.slice(max(0, joined.num_rows - window))
        if tail is not None:
            yield from rows(tail, here + 1, 0)
        if seen:
            group, key, vid, staying = (np.concatenate(x) for x in zip(*seen, strict=True))
            n, miss = len(vid), _misses(group, key, staying, window)
            none = [pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(vid), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(miss)],
                names)

    return run


def _across(window: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("late", "pass", "label", "size", "key", "vid")])
        found = list(_links_of(table, window, threshold))
        return pa.table({"a": np.concatenate([np.zeros(0, np.int64), *[a for a, _ in found]]),
                         "b": np.concatenate([np.zeros(0, np.int64), *[b for _, b in found]])})

    return run


def _crowds(threshold: float):
    """Edges of a spanning forest of all pairs within one block, or between two."""

    def run(table: pa.Table) -> pa.Table:
        side, vid = table.column("side").to_numpy(), table.column("vid").to_numpy()
        vec = _unit(table.column("vec").to_pylist())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a, b = np.nonzero(vec[left] @ vec[right].T >= threshold)
        a, b = left[a], right[b]
        a, b = _forest(vid, a[a != b], b[a != b])
        return pa.table({"a": a, "b": b})

    return run


def crowded(single: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) among the vectors that the passes may have missed links of, by exact comparison."""
    dense = reliable(found.where("miss is not null").groupBy("vid").agg(F.sum("miss").alias("miss")).where(
        F.col("miss") > math.log(MISS)).select("vid").join(single, "vid").select(
        "vid", "label", F.length("vec").alias("size"), "vec"))
    sizes = dense.groupBy("label", "size").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("blocks"))
    own = dense.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, ["label", "size"]).withColumn(
        "own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return own.select("label", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
                      .alias("side"), "vid", "vec").groupBy("label", "size", "i", "j").applyInArrow(
        _crowds(threshold), "a bigint, b bigint")


def _counted(threshold: float):
    """Weighted direct links of each vector with the vectors of its component in two blocks."""

    def run(table: pa.Table) -> pa.Table:
        root, side = table.column("root").to_numpy(), table.column("side").to_numpy()
        vid, weight = table.column("vid").to_numpy(), table.column("weight").to_numpy()
        raw = table.column("vec").to_pylist()
        ids, counts = [], []
        order = np.argsort(root, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(root[order])) + 1) if len(order) else []:
            if (side[at] < 0).all():
                x = _unit([raw[i] for i in at])
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                ids.append(vid[at])
                counts.append(near @ weight[at])
                continue
            left, right = at[side[at] == 0], at[side[at] == 1]
            if len(left) and len(right):
                near = _unit([raw[i] for i in left]) @ _unit([raw[i] for i in right]).T >= threshold
                ids += [vid[left], vid[right]]
                counts += [near @ weight[right], near.T @ weight[left]]
        return pa.table({"vid": np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64),
                         "links": np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = 0.98, passes: int = PASSES,
                    window: int = WINDOW, seed: int = 5) -> DataFrame:
    """One row per vector row: the id, n_links, component_id and kept.

    Only vectors of equal labels, none null, and of equal length are compared, by cosine in double
    precision. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing and are their own component. ``n_links`` counts rows, equal vectors included. Repeated ids
    are rows like any other; an empty table gives an empty result; other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = reliable(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                                   F.col(vector_col).alias("v")).mapInArrow(
        _valid, f"id {kind}, label string, vid bigint, vec binary"))
    single = reliable(rows.where("vid is not null").groupBy("vid").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("weight")))
    largest = single.groupBy("label", F.length("vec")).count().agg(F.max("count")).first()[0] or 0
    chance = same_side(threshold) ** max(0.0, math.log2(max(largest, 1) / window) + 1)
    if largest > window and chance < 1:
        passes = max(passes, min(MOST_PASSES, math.ceil(math.log(EVEN) / math.log1p(-chance)) if chance > 0 else MOST_PASSES))
    parts = max(1, -(-single.count() * passes // ROWS))
    keyed = single.select("vid", "label", "vec").mapInArrow(
        _keys(passes, seed), "pass int, label string, size int, key bigint, vid bigint, vec binary")
    order = ["pass", "label", "size", "key", "vid"]
    found = reliable(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _windows(window, threshold, passes, seed), EDGES))
    borders = found.where("edge is not null").drop("a", "b", "miss").groupBy("edge").applyInArrow(
        _across(window, threshold), "a bigint, b bigint")
    roots = components(found.where("a is not null").select("a", "b").unionAll(borders).unionAll(
        crowded(single, found, threshold)))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = reliable(roots.join(sizes, "root").join(single, F.col("node") == F.col("vid")).select(
        "vid", "root", "weight", "vec", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    one = members.where("blocks = 1").select(
        F.pmod(F.xxhash64("root"), F.lit(max(1, parts))).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"),
        F.lit(-1).alias("side"), "root", "vid", "weight", "vec")
    many = members.where("blocks > 1").withColumn("own", own).withColumn(
        "other", F.explode(F.expr("sequence(0, blocks - 1)")))
    many = many.select(F.col("root").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
                       .alias("side"), "root", "vid", "weight", "vec")
    links = one.unionAll(many).groupBy("g", "i", "j").applyInArrow(
        _counted(threshold), "vid bigint, links bigint").groupBy("vid").agg(F.sum("links").alias("links"))
    least = rows.where("vid is not null").groupBy("vid").agg(F.min("id").alias("low"))
    rooted = least.join(roots, F.col("vid") == F.col("node"), "left").select(
        "vid", "low", F.coalesce("root", "vid").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = single.select("vid", "weight").join(links, "vid", "left").join(rooted, "vid").join(lowest, "root").select(
        "vid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "vid").join(known, "vid", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
