"""Size-aware heavy-light Jaccard join of documents as sets of word shingles.

Small (light) sets enumerate subsets of fixed size: two sets of a and b shingles link exactly when
they share a subset of the overlap their sizes demand, so one subset in common proves the link and a
group of equal subsets is joined without comparing its members. Large (heavy) sets are found by
scanning inverted lists: shingles get one global order, frequent ones last, and each set is listed
under its first shingles only, as many as any linked pair must share one of. The boundary between the
two is the size up to which enumerating costs no more than scanning.

Equal sets are one set throughout. Lists travel as packed arrays, dealt by shingle. A long list is not
expanded into pairs: its members are compared with few leaders, components are formed, and only
members still apart are compared again. The result is exact up to 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WordHashes, light_batches, mix, reliable, shingle_set, small
from .components import components

#: Local count from which a shingle is reported as frequent, and total count from which it is ranked.
LOCAL_FREQUENT, FREQUENT = 4, 24
#: Frequent shingles that take part in the order (16 bytes each to every task). Any order gives the
#: same links; shingles beyond the bound are merely not moved to the end.
RANKED = 150_000
#: Members from which a list is handled by leaders instead of all its pairs.
LONG_LIST = 40
#: Bins of the histogram of hashes that bounds the intersection of two sets from above.
BINS = 32
#: Hashes a bin of the finer histogram of large sets holds on average at most, and the size from which sets have
#: one. Its bins grow with the set, as a fixed number tells sets apart only up to a size.
WIDE_LOAD, WIDE_FROM = 8, 300
#: Size from which BINS bins leave room for nearly any overlap, so that they are not worth sending.
COARSE_BELOW = 700
#: Members of one leader that are verified in one group, and sets in a block of a long list.
STAR, BLOCK = 256, 512
#: Postings in one range of shingles, the unit of a reducing task.
RANGE = 800_000
#: Sizes the boundary may reach: subsets of larger sets are too many to enumerate.
LARGEST_LIGHT = 12
#: Cost of one inverted-list entry relative to one enumerated subset.
SCAN_COST = 16


def overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def smallest(n: int, percent: int) -> int:
    """The smallest size that can link with size n."""
    return -(-percent * n // 100)


def subset_plan(n: int, percent: int, limit: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) of every pairing of a set of n with sizes up to limit."""
    return [(min(n, b), max(n, b), overlap(n, b, percent))
            for b in range(smallest(n, percent), min(n * 100 // percent, limit) + 1)]


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The size up to which enumerating subsets costs no more than scanning lists."""
    best, gain, total = 1, 0, 0
    for n in range(1, LARGEST_LIGHT + 1):
        subsets = sum(math.comb(n, c) for _, _, c in subset_plan(n, percent, LARGEST_LIGHT) if c <= n)
        scan = (n - smallest(n, percent) + 1) * SCAN_COST
        total += histogram.get(n, 0) * (scan - subsets)
        if total >= gain and subsets <= 4 * scan:
            best, gain = n, total
    return best


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def histogram_of(shingles: np.ndarray, bins: int = BINS) -> bytes:
    """Counts of the hashes by bin, at most 255 each; 255 stands for any larger count."""
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % bins, minlength=bins)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def wide_bins(n: int) -> int:
    """Bins of the finer histogram, a power of two; those of sizes that can link differ by one halving at most."""
    return 1 << max(6, (-(-n // WIDE_LOAD) - 1).bit_length())


def _folded(x: np.ndarray) -> np.ndarray:
    """Rows of histograms with half the bins."""
    half = x.shape[1] // 2
    return np.minimum(x[:, :half].astype(np.uint16) + x[:, half:], 255).astype(np.uint8)


def _possible(x: np.ndarray, y: np.ndarray, na, nb, percent: int) -> np.ndarray:
    """Whether histograms leave room for the overlap a link needs; a full bin leaves all room."""
    if x.shape[1] > y.shape[1]:
        x = _folded(x)
    elif y.shape[1] > x.shape[1]:
        y = _folded(y)
    low = np.minimum(x, y)
    bound = low.sum(1, dtype=np.int64)
    return (low == 255).any(1) | ((100 + percent) * bound >= percent * (na + nb))


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def describe(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows of two kinds: (id, n, sid, wide) per document row, and (token, count) of locally frequent shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, pool, held, schema = WordHashes(), set(), [], 0, None

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(pool), return_counts=True)
            keep = counts >= LOCAL_FREQUENT
            n = int(keep.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, schema), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                 pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names)

        for batch in small(batches):
            schema = batch.schema.field(0).type
            sizes, sids, wide = [], [], []
            for text in _texts(batch.column(1)):
                s = shingle_set(text, hashes, width)
                sid = set_id(s) if len(s) else None
                sizes.append(len(s))
                wide.append(histogram_of(s, wide_bins(len(s))) if len(s) >= WIDE_FROM else None)
                sids.append(sid)
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    pool.append(s)
                    held += len(s)
            if len(seen) > 500_000:
                seen.clear()
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(wide, pa.binary()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            if held > 1_000_000:
                yield frequent()
                pool, held = [], 0
        if pool:
            yield frequent()

    names = ["id", "n", "sid", "wide", "token", "count"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n bigint, sid bigint, wide binary, token bigint, count bigint")


def postings(docs: DataFrame, text_col: str, width: int, percent: int, light: int, ranges: int,
             ranked: tuple) -> DataFrame:
    """Packed postings by range of shingles; `sure` marks those of enumerated subsets."""
    least_listed = smallest(light + 1, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = ranked[0].value, ranked[1].value
        hashes, seen, full = WordHashes(), set(), b"\xff" * BINS
        plans = {n: subset_plan(n, percent, light) for n in range(1, light + 1)}
        listed, sure = _Packer(ranges), _Packer(ranges)

        for batch in small(batches):
            for text in _texts(batch.column(0)):
                s = shingle_set(text, hashes, width)
                n = len(s)
                if not n or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                if n <= light:
                    keys = [_subset_key(c, a, b) for a, b, k in plans[n] if k <= n
                            for c in itertools.combinations(s.tolist(), k)]
                    sure.add(np.array(keys, np.uint64), sid, n, b"")
                if n >= least_listed:
                    listed.add(_ordered(s, frequent, counts)[:n - smallest(n, percent) + 1], sid, n,
                               histogram_of(s) if n < COARSE_BELOW else full)
                for packer, flag in ((listed, False), (sure, True)):
                    if packer.held > RANGE // 2:
                        yield from packer.flush(flag)
            if len(seen) > 500_000:
                seen.clear()
        for packer, flag in ((listed, False), (sure, True)):
            yield from packer.flush(flag)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(
        run, "range int, sure boolean, tokens binary, who binary, place binary, sids binary, sizes binary, bins binary")


def _subset_key(members: tuple[int, ...], a: int, b: int) -> int:
    """Hash of the subset and the sizes it is for; odd exactly for subsets of equal sizes."""
    return (xxhash.xxh64_intdigest(np.array((*members, a, b), np.uint64).tobytes()) & ~1) | (a == b)


def _ordered(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare shingles by hash, then frequent ones by count and hash."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    known = frequent[at] == s
    if not known.any():
        return s
    late = s[known]
    return np.concatenate([s[~known], late[np.argsort(counts[at[known]], kind="stable")]])


class _Packer:
    def __init__(self, ranges: int):
        self.ranges = ranges
        self.clear()

    def clear(self) -> None:
        self.tokens, self.lengths, self.sids, self.sizes, self.bins, self.held = [], [], [], [], [], 0

    def add(self, tokens: np.ndarray, sid: int, n: int, bins: bytes) -> None:
        self.tokens.append(tokens)
        self.lengths.append(len(tokens))
        self.sids.append(sid)
        self.sizes.append(n)
        self.bins.append(bins)
        self.held += len(tokens)

    def flush(self, sure: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        tokens, lengths = np.concatenate(self.tokens), np.array(self.lengths)
        who = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        place = (np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
        sids, sizes = np.array(self.sids, np.int64), np.array(self.sizes, np.uint32)
        bins = np.frombuffer(b"".join(self.bins), np.uint8).reshape(len(sids), -1)
        self.clear()
        part = (mix(tokens) % np.uint64(self.ranges)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.ranges + 1))
        for r in range(self.ranges):
            rows = order[edges[r]:edges[r + 1]]
            if len(rows):
                used, local = np.unique(who[rows], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([sure])] + [
                        pa.array([x.tobytes()], pa.binary()) for x in (
                            tokens[rows], local.astype(np.uint32), place[rows], sids[used], sizes[used], bins[used])],
                    ["range", "sure", "tokens", "who", "place", "sids", "sizes", "bins"])


PAIRS = "kind int, token bigint, a bigint, b bigint, n bigint, place bigint, bins binary"


def _candidates(percent: int, light: int):
    """Of one range: proven links (kind 0), pairs to verify (kind 1), members of long lists (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        links, pairs, lists = [], [], []
        for sure in (True, False):
            rows = [r for r in table.to_pylist() if r["sure"] == sure]
            if not rows:
                continue
            known = [np.frombuffer(r["sids"], np.int64) for r in rows]
            base = np.cumsum([0] + [len(k) for k in known])
            sids, first, dense = np.unique(np.concatenate(known), return_index=True, return_inverse=True)
            sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows])[first].astype(np.int64)
            tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint64) for r in rows])
            who = dense[np.concatenate([np.frombuffer(r["who"], np.uint32) + b
                                        for r, b in zip(rows, base[:-1], strict=True)])]
            place = np.concatenate([np.frombuffer(r["place"], np.uint32) for r in rows]).astype(np.int64)
            bins = None if sure else np.concatenate(
                [np.frombuffer(r["bins"], np.uint8).reshape(-1, BINS) for r in rows])[first]
            del rows
            tokens, who, place, starts = _lists(tokens, who, place)
            if sure:
                for at, end in itertools.pairwise(starts.tolist()):
                    w = who[at:end]
                    n = sizes[w]
                    # A subset for two sizes proves links between them only, one for equal sizes among all.
                    if n.min() < n.max() or int(tokens[at]) & 1:
                        links.append(np.stack([np.full(len(w) - 1, sids[w[0]]), sids[w[1:]]], 1))
                continue

            def keep(left, right, who=who, place=place, sizes=sizes, bins=bins, sids=sids) -> None:
                a, b = who[left], who[right]
                good = np.maximum(sizes[a], sizes[b]) > light
                good &= _viable(sizes[a], place[left], sizes[b], place[right], percent)
                a, b = a[good], b[good]
                good = _possible(bins[a], bins[b], sizes[a], sizes[b], percent)
                pairs.append(np.stack([sids[a[good]], sids[b[good]]], 1))

            lengths = np.diff(starts)
            short = lengths <= LONG_LIST
            for m in np.unique(lengths[short]).tolist():
                at = starts[:-1][short & (lengths == m)]
                i, j = np.triu_indices(m, 1)
                step = max(1, 150_000 // len(i))
                for k in range(0, len(at), step):
                    keep((at[k:k + step, None] + i).ravel(), (at[k:k + step, None] + j).ravel())
            for k in np.flatnonzero(~short).tolist():
                span = np.arange(starts[k], starts[k + 1])
                span = span[np.argsort(sizes[who[span]], kind="stable")]
                n, lead = sizes[who[span]], 0
                while lead < len(span):
                    end = int(np.searchsorted(n, n[lead] * 100 // percent, side="right"))
                    keep(np.full(end - lead - 1, span[lead]), span[lead + 1:end])
                    lead = end
                lists.append((np.full(len(span), tokens[starts[k]].view(np.int64)), sids[who[span]], n, place[span],
                              bins[who[span]]))
        return _packed(links, pairs, lists)

    return run


def _packed(links, pairs, lists) -> pa.Table:
    out = []
    for kind, found in enumerate((links, pairs)):
        both = np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        both = both[np.r_[True, (both[1:] != both[:-1]).any(1)]] if len(both) else both
        n, none = len(both), pa.nulls(len(both), pa.int64())
        out.append([pa.array(np.full(n, kind, np.int32)), none, pa.array(both[:, 0]), pa.array(both[:, 1]), none, none,
                    pa.nulls(n, pa.binary())])
    for token, a, n, place, bins in lists:
        out.append([pa.array(np.full(len(a), 2, np.int32)), pa.array(token), pa.array(a), pa.nulls(len(a), pa.int64()),
                    pa.array(n), pa.array(place), pa.array([b.tobytes() for b in bins], pa.binary())])
    names = [c.split()[0] for c in PAIRS.split(", ")]
    return pa.concat_tables([pa.table(dict(zip(names, c, strict=True))) for c in out])


def _lists(tokens, who, place):
    """Entries of tokens held by two sets or more, by token; the bounds of the lists."""
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    many = np.repeat(np.diff(np.r_[new, len(t)]) > 1, np.diff(np.r_[new, len(t)]))
    rows = order[many]
    rows = rows[np.lexsort((who[rows], tokens[rows]))]
    t, w = tokens[rows], who[rows]
    fresh = np.r_[True, (t[1:] != t[:-1]) | (w[1:] != w[:-1])] if len(t) else np.zeros(0, bool)
    rows = rows[fresh]
    t = tokens[rows]
    new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.r_[new, len(t)])
    rows = rows[np.repeat(size > 1, size)]
    size = size[size > 1]
    return tokens[rows], who[rows], place[rows], np.r_[0, np.cumsum(size)].astype(np.int64)


def _viable(na, pa_, nb, pb, percent: int):
    """Whether sizes and places still allow the overlap a link needs, if nothing earlier is shared."""
    fits = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    return fits & ((100 + percent) * np.minimum(na - pa_, nb - pb) >= percent * (na + nb))


def plausible(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose finer histograms leave room for a link; pairs with a small set stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            kept = [k for k, (x, y, na, nb) in enumerate(zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True))
                    if x is None or y is None or _possible(
                        np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None], na, nb, percent)[0]]
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    left = wide.select(F.col("sid").alias("a"), F.col("wide").alias("x"), F.col("size").alias("na"))
    right = wide.select(F.col("sid").alias("b"), F.col("wide").alias("y"), F.col("size").alias("nb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", "x", "y", "na", "nb").mapInArrow(
        run, "a bigint, b bigint")


def sets_for(roles: DataFrame, docs: DataFrame, members: DataFrame, id_col: str, text_col: str,
             width: int) -> DataFrame:
    """(sid, keys, shingles): every role (sid, keys) with its set, read from one document each."""
    known = members.join(roles.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(
        F.min("id").alias("_wanted"))
    kind = roles.schema["keys"].dataType.simpleString()
    roles = reliable(roles.join(known, "sid").groupBy("sid", "_wanted").agg(F.collect_list("keys").alias("keys")))
    few = roles.count() <= BROADCAST_ROWS
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(roles) if few else roles, F.col("id").eqNullSafe(F.col("_wanted"))).select("text", "sid", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            rows, raw = [], []
            wanted = batch.column(1).to_pylist()
            for k, t in enumerate(_texts(batch.column(0))):
                s = shingle_set(t, hashes, width)
                if len(s) and set_id(s) == wanted[k]:  # a repeated id may have brought another text
                    rows.append(k)
                    raw.append(s.tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(raw, pa.binary())],
                                             ["sid", "keys", "shingles"])

    found = chosen.mapInArrow(run, f"sid bigint, keys array<{kind}>, shingles binary")
    return found.select("sid", F.explode("keys").alias("keys"), "shingles")


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, id_col: str, text_col: str,
             width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is high enough.

    Each pair is checked in the group of its first set, the leader, which many-paired leaders have
    several of. Sets are read from one document each, and travel once per group that needs them.
    """
    spans = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    led = pairs.join(spans, "a").select("a", "b", F.struct(F.col("a").alias("lead"), F.pmod(
        F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")).alias("keys"))
    roles = led.select(F.col("b").alias("sid"), "keys").unionAll(
        led.select(F.col("a").alias("sid"), "keys").distinct())
    found = sets_for(roles, docs, members, id_col, text_col, width).select(
        "sid", F.col("keys.lead").alias("lead"), F.col("keys.salt").alias("salt"), "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, place = None, None
        for batch in small(batches):
            a, b = [], []
            for sid, lead, salt, raw in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
                s = np.frombuffer(raw, np.uint64)
                if sid == lead:
                    leader, place = s, (lead, salt)
                    continue
                if place != (lead, salt):
                    raise RuntimeError("a group has no leader")
                at = np.minimum(np.searchsorted(leader, s), len(leader) - 1)
                same = int((leader[at] == s).sum())
                if same * (100 + percent) >= percent * (len(leader) + len(s)):
                    a.append(lead)
                    b.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = found.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.col("sid") != F.col("lead"))
    return found.mapInArrow(check, "a bigint, b bigint").distinct()


def still_open(lists: DataFrame, roots: DataFrame, wide: DataFrame) -> DataFrame:
    """(main, sid, root, n, bins, wide) of long lists that hold several components so far.

    Lists are put together by their largest component, their main one: the lists of a group of near
    copies, of which there are as many as shared shingles, become one. All pairs of a list are pairs
    of its group.
    """
    now = lists.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn(
        "root", F.coalesce("root", "a"))
    sizes = now.groupBy("token", "root").count()
    main = sizes.groupBy("token").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("parts")).where(
        "parts > 1").select("token", F.col("top.root").alias("main"))
    open_ = now.join(main, "token").groupBy("main", F.col("a").alias("sid")).agg(
        *[F.first(c).alias(c) for c in ("root", "n", "bins")])
    return open_.join(wide.select("sid", "wide"), "sid", "left")


def in_blocks(rows: DataFrame, left: Column, right: Column, keep: list[str]) -> DataFrame:
    """Rows dealt to pairs of blocks: left members of one block meet right members of another.

    Adds ``keys``: main, block of the left side, block of the right side, and which sides the row is on.
    """
    sides = rows.withColumn("l", left).withColumn("r", right).where("l or r")
    blocks = sides.groupBy("main").agg(
        F.ceil(F.count_if("l") / BLOCK).cast("int").alias("ls"), F.ceil(F.count_if("r") / BLOCK).cast("int").alias("rs"))
    dealt = sides.join(blocks.where("ls > 0 and rs > 0"), "main").withColumn("h", F.xxhash64("sid"))
    cell = "named_struct('main', main, 'i', {i}, 'j', {j}, 'left', {s})"
    mine = {"i": "cast(pmod(h, ls) as int)", "j": "cast(pmod(h, rs) as int)"}
    as_left = F.expr(f"if(l, transform(sequence(0, rs - 1), x -> {cell.format(i=mine['i'], j='x', s='true')}), array())")
    as_right = F.expr(f"if(r, transform(sequence(0, ls - 1), x -> {cell.format(i='x', j=mine['j'], s='false')}), array())")
    return dealt.select(*keep, F.explode(F.concat(as_left, as_right)).alias("keys"))


def promising(rows: DataFrame, percent: int, light: int) -> DataFrame:
    """(main, sid, root, l, r): members with a partner of another component that sizes and histograms allow."""

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        sid, root, n = (table.column(c).to_numpy() for c in ("sid", "root", "n"))
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        finer = [np.frombuffer(w or b"", np.uint8) for w in table.column("wide").to_pylist()]
        width = np.array([len(w) for w in finer])
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        # Histograms of one width as rows of one array, and the row of each right member.
        own, row = {}, np.zeros(len(b), np.int64)
        for w in np.unique(width[b]).tolist():
            at = np.flatnonzero(width[b] == w)
            own[w], row[at] = np.stack([finer[k] for k in b[at]]), np.arange(len(at))
        halves = {w: _folded(x) for w, x in own.items() if w}
        found_a, found_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for k, x in enumerate(a):
            good = np.flatnonzero((root[b] != root[x]) & (np.maximum(n[b], n[x]) > light)
                                  & (100 * np.minimum(n[b], n[x]) >= percent * np.maximum(n[b], n[x])))
            good = good[_possible(bins[b[good]], bins[x][None], n[b[good]], n[x], percent)]
            if width[x]:
                parts = []
                for w in np.unique(width[b[good]]).tolist():
                    some = good[width[b[good]] == w]
                    if w:
                        rows_ = (halves if w > width[x] else own)[w][row[some]]
                        some = some[_possible(rows_, finer[x][None], n[b[some]], n[x], percent)]
                    parts.append(some)
                good = np.concatenate([np.zeros(0, np.int64), *parts])
            found_a[k] = len(good) > 0
            found_b[good] = True
        at = np.r_[a[found_a], b[found_b]]
        is_left = np.r_[np.ones(int(found_a.sum()), bool), np.zeros(int(found_b.sum()), bool)]
        main = table.column("main").to_numpy()
        return pa.table({"main": main[at], "sid": sid[at], "root": root[at], "l": is_left, "r": ~is_left})

    dealt = in_blocks(rows, F.col("root") != F.col("main"), F.lit(True), ["sid", "root", "n", "bins", "wide"])
    dealt = dealt.select("keys.*", "sid", "root", "n", "bins", "wide")
    found = dealt.groupBy("main", "i", "j").applyInArrow(run, "main bigint, sid bigint, root bigint, l boolean, r boolean")
    return found.groupBy("main", "sid", "root").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))


def linked_in_blocks(rows: DataFrame, docs: DataFrame, members: DataFrame, id_col: str, text_col: str,
                     width: int, percent: int) -> DataFrame:
    """Links between different components of one group, found by scanning inverted lists block by block.

    Each left set gives one link at most for every component it reaches in a block.
    """
    roles = in_blocks(rows, F.col("l"), F.col("r"), ["sid", "root"]).select(
        "sid", F.col("keys").withField("root", F.col("root")).alias("keys"))
    sets = sets_for(roles, docs, members, id_col, text_col, width).select("keys.*", "sid", "shingles")

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        sid, root = table.column("sid").to_numpy(), table.column("root").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in found])
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        out_a, out_b = [], []
        if len(a) and len(b):
            tokens = np.concatenate([found[k] for k in b])
            who = np.repeat(np.arange(len(b)), size[b])
            order = np.argsort(tokens, kind="stable")
            tokens, who = tokens[order], who[order]
            for x in a:
                lo = np.searchsorted(tokens, found[x])
                hi = np.searchsorted(tokens, found[x], side="right")
                count = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                same = np.bincount(who[at], minlength=len(b))
                good = b[((100 + percent) * same >= percent * (size[b] + size[x])) & (root[b] != root[x])]
                good = good[np.unique(root[good], return_index=True)[1]]
                out_a.append(np.full(len(good), sid[x]))
                out_b.append(sid[good])
        cat = lambda v: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64)
        return pa.table({"a": cat(out_a), "b": cat(out_b)})

    return sets.groupBy("main", "i", "j").applyInArrow(run, "a bigint, b bigint")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
         percent: int = 75) -> DataFrame:
    """One row per document row: the id, n_shingles and component_id, the smallest id reachable by links.

    A text of fewer than ``width`` words is one shingle. Null texts and texts without words have no
    shingle, link with nothing and are their own component. Equal texts always share a component. Rows
    whose ids are null keep a null component unless a linked row has an id; repeated ids are rows like
    any other. An empty table gives an empty result; columns of other names are ignored.
    """
    spark = docs.sparkSession
    light_batches(spark)
    described = reliable(describe(docs, id_col, text_col, width))
    members = described.where("count is null").select("id", "n", "sid")
    wide = described.where("wide is not null").groupBy("sid").agg(F.first("wide").alias("wide"), F.first("n").alias("size"))
    top = described.where("count is not null").groupBy("token").agg(F.sum("count").alias("count")).where(
        F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(RANKED).toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    ranked = tuple(spark.sparkContext.broadcast(x[order]) for x in (tokens, top["count"].to_numpy()))
    total = members.select(F.sum("n")).first()[0] or 0
    histogram = {r["n"]: r["count"] for r in members.where(F.col("n").between(1, LARGEST_LIGHT)).select(
        "n", "sid").distinct().groupBy("n").count().collect()}
    light = boundary(histogram, percent)
    ranges = max(12, round(total * (100 - percent) / 100 / RANGE))
    packed = postings(docs, text_col, width, percent, light, ranges, ranked)
    found = reliable(packed.repartition(ranges, "range").groupBy("range").applyInArrow(
        _candidates(percent, light), PAIRS))
    proven = found.where("kind = 0").select("a", "b")
    pairs = reliable(plausible(found.where("kind = 1").select("a", "b").distinct(), wide, percent))
    lists = found.where("kind = 2").select("token", "a", "n", "place", "bins")

    def check(some: DataFrame) -> DataFrame:
        return verified(some, docs, members, id_col, text_col, width, percent)

    # First one pair for each set: groups of copies join by as many comparisons as they have members.
    one = reliable(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = reliable(check(one).unionAll(proven))
    roots = components(links)
    # Then other pairs whose ends are still apart, and long lists that hold several components.
    rest = reliable(between(pairs, roots).join(one, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = reliable(links.unionAll(check(rest)))
        roots = components(links)
    apart = reliable(promising(still_open(lists, roots, wide), percent, light))
    if not apart.isEmpty():
        more = linked_in_blocks(apart, docs, members, id_col, text_col, width, percent)
        roots = components(links.unionAll(more))
    return _ids(members, roots).withColumnRenamed("id", id_col)


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").where(
        F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _ids(members: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    joined = rooted.join(least, "root", "left")
    return joined.select("id", F.col("n").alias("n_shingles"),
                         F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
