"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the words seen in training, one symbol for every other word, and the end of a text. The
root of the tree predicts symbols by their training counts, with the mass of unseen ones estimated
from the words seen once. Deeper states are contexts of up to three preceding words. A context is a
state when its predictions diverge enough from those of its longest shorter state to pay for their
number (a description-length test), and each state stores the symbols it predicts often; all other
symbols are left to the shorter state, discounted so that the probabilities still add up to one.
A text is scored by the longest state that its last words match, symbol by symbol.

The root needs the count of every word: words are counted by task and then in ranges of hashes, and the
occurrences of all but the most frequent meet their counts by hash. Sequences count from a fixed number of occurrences, so the tree grows
with the corpus: it is a table, grown length by length with joins. What a state changes is written as
one weight for each sequence, and a text is scored by the sum of the weights of its sequences. The most
frequent ones travel to every task; the places of all others meet their weights by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, freed_shuffles, light_batches, mix, reliable, unmix, written  # noqa: F401

DEPTH = 3
#: Least count of a sequence in all training texts, wherever its occurrences lie.
LEAST = 4
#: Weights of sequences, and counts of words, that travel to every task at most, the most frequent ones; others are joined.
HOT = 500_000
DISCOUNT = 0.5
#: Entries of one range of words, the unit of a reducing task; distinct entries, and places, a task holds at once.
RANGE, HELD, POOL = 1_200_000, 1_500_000, 2_000_000
#: Low bits of the hashes of pairs that the first count leaves out. Pairs that share the rest can only look more frequent.
DROPPED = 24
END = b"\n"
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_BACK = np.uint64(pow(int(_STEP[1]), -1, 1 << 64))


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: What to keep of eight bytes of which so many belong to a word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def held_out(doc_id):
    """Whether a row takes no part in training: crc32 of the id as text, modulo 5, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def _before(words: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Hashes of sequences with one more word before them."""
    return mix(shorter * _STEP[1] + mix(words + _STEP[2]))


def _without(words: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Hashes of sequences without their first words: undoes ``_before``."""
    return (unmix(longer) - mix(words + _STEP[2])) * _BACK


def grams(words: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """Hashes of the 1 to depth + 1 words that end at each place; zero where a text has no so many.

    ``starts`` holds for each place how many words of its text come before it.
    """
    out = [mix(words + _STEP[0])]
    for k in range(1, depth + 1):
        longer = np.zeros(len(words), np.uint64)
        # A sequence is hashed from its end: its shorter form without the first word is out[k - 1].
        longer[k:] = _before(words[:-k], out[k - 1][k:])
        longer[starts < k] = 0
        out.append(longer)
    return out


def _lanes(raw: bytes, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on as one number."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 8)
    return windows[at].view(np.uint64).ravel() & _KEEP[np.minimum(width, 8)]


def _hashed(lanes: np.ndarray, more: np.ndarray, width: np.ndarray) -> np.ndarray:
    return mix(mix(lanes + width.astype(np.uint64) * _STEP[3]) + more * _STEP[1])


#: The end, which no word equals, as it is white space.
_ENDS = _hashed(np.array([ord(END)], np.uint64), np.zeros(1, np.uint64), np.ones(1, np.int64))[0]


def _places(texts: list[bytes | None], hashes: WordHashes):
    """Word hashes of all texts in one array with an end each, places within texts, and lengths.

    Words of up to 16 bytes are hashed all at once from two numbers, longer ones by ``hashes``.
    """
    found = [t or b"" for t in texts]
    bounds = np.cumsum([1, *[len(t) + 1 for t in found]])
    raw = b"".join([END, *[x for t in found for x in (t, END)]]).lower() + bytes(16)
    white = _WHITE[np.frombuffer(raw, np.uint8)[:bounds[-1]]]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, width = edges[::2], edges[1::2] - edges[::2]
    more, second = np.zeros(len(starts), np.uint64), np.flatnonzero(width > 8)
    more[second] = _lanes(raw, starts[second] + 8, width[second] - 8)
    words = _hashed(_lanes(raw, starts, width), more, width)
    far = np.flatnonzero(width > 16)
    if len(far):
        words[far] = hashes.of([raw[x:x + n] for x, n in zip(starts[far].tolist(), width[far].tolist(), strict=True)])
    lengths = np.diff(np.searchsorted(starts, bounds)) + 1
    last = np.cumsum(lengths) - 1
    inner = np.ones(int(lengths.sum()), bool)
    inner[last] = False
    flat = np.full(len(inner), _ENDS, np.uint64)
    flat[inner] = words
    return flat, np.arange(len(flat)) - np.repeat(last + 1 - lengths, lengths), lengths


def _range(values: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges by the first bits, as Spark's functions can tell them too."""
    return ((values >> np.uint64(40)) % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _chunks(batch: pa.RecordBatch, size: int = 250) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, size):
        yield batch.slice(k, size)


CELLS = ("a", "b", "c", "d")
GATHERED = "part int, size int, " + ", ".join(f"{c} binary" for c in CELLS)


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, so that those which are mostly zero compress to nothing."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Sorted hashes by their differences, whose high bytes are zero."""
    return _planes(np.diff(values, prepend=np.zeros(1, np.uint64)))


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, np.uint64), dtype=np.uint64)


def _cells(part: int, size: int, raw: list[bytes]) -> pa.RecordBatch:
    cells = [pa.array([x], pa.binary()) for x in raw] + [pa.nulls(1, pa.binary())] * (len(CELLS) - len(raw))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([size], pa.int32()), *cells],
                                      ["part", "size", *CELLS])


def _part(values: np.ndarray, ranges: int) -> np.ndarray:
    # Short integers are sorted in one sweep.
    return (mix(values) % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)


def _by_part(part: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(ranges + 1))
    for r in range(ranges):
        if edges[r] < edges[r + 1]:
            yield r, order[edges[r]:edges[r + 1]]


def _counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, their summed counts, and where each occurs first."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    new = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[new], np.add.reduceat(counts, new) if len(new) else counts, order[new]


class _Pool:
    """Counts of one size of sequences in a task, and the first word of each if it is asked for."""

    def __init__(self, size: int, ranges: int, firsts: bool = False):
        self.size, self.ranges, self.firsts = size, ranges, firsts
        self.clear()

    def clear(self) -> None:
        self.new, self.places = [], 0
        self.held = [np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * self.firsts]

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.new.append(columns)
        self.places += len(columns[0])
        if self.places > POOL // 2:
            self.merge()
            if len(self.held[0]) > HELD:
                yield from self.flush()

    def merge(self) -> None:
        fresh = [np.concatenate(c) for c in zip(*self.new, strict=True)]
        self.new, self.places = [], 0
        if self.firsts:
            # A sequence has one first word, so which of its places comes first does not matter.
            order = np.argsort(fresh[0])
            fresh = [c[order] for c in fresh]
        else:
            fresh[0].sort()
        new = np.flatnonzero(np.r_[True, fresh[0][1:] != fresh[0][:-1]][:len(fresh[0])])
        counts = np.diff(np.r_[new, len(fresh[0])])
        fresh = [fresh[0][new], counts, *[c[new] for c in fresh[1:]]]
        if len(self.held[0]):
            values, counts, *firsts = [np.concatenate(c) for c in zip(self.held, fresh, strict=True)]
            values, counts, first = _counted(values, counts)
            fresh = [values, counts, *[c[first] for c in firsts]]
        self.held = fresh

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.new:
            self.merge()
        values, counts, *firsts = self.held
        self.clear()
        counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
        for r, at in _by_part(_part(values, self.ranges), self.ranges):
            cell = [_steps(values[at]), _planes(counts[at])]
            for words in firsts:
                known, place = np.unique(words[at], return_inverse=True)
                cell += [_steps(known), _planes(place.astype(np.uint32))]
            yield _cells(r, self.size, cell)


def gather(rows: DataFrame, ranges: int) -> DataFrame:
    """Counts by task of training words, and of pairs of words by the high bits of their hashes, by range of hashes.

    ``rows``: key, text, held. One pass over the corpus yields both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, pairs = WordHashes(), _Pool(1, ranges), _Pool(2, ranges)
        for batch in batches:
            for part in _chunks(batch):
                learn = part.filter(pa.array([not h for h in part.column(2).to_pylist()], pa.bool_()))
                flat, place, _ = _places(_binary(learn.column(1)), hashes)
                yield from words.add(flat)
                yield from pairs.add(grams(flat, place, 1)[1][place > 0] >> np.uint64(DROPPED))
        yield from words.flush()
        yield from pairs.flush()

    return rows.mapInArrow(run, GATHERED)


SUMS = "gram bigint, size int, count bigint, vocabulary bigint, once bigint, tokens bigint"


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _counted(np.concatenate([_from_steps(r["a"]) for r in rows]),
                    np.concatenate([_from_planes(r["b"], np.uint32) for r in rows]).astype(np.int64))


def _sums(table: pa.Table) -> pa.Table:
    """Of one range: every word with its count, high bits of the hashes of pairs (size 2) with the least count or more,
    and counts of the range. A range has all occurrences of what falls into it, so counts are those of the corpus."""
    names, kinds = zip(*[c.split() for c in SUMS.split(", ")], strict=True)
    kinds = [{"bigint": pa.int64(), "int": pa.int32()}[k] for k in kinds]

    def piece(n: int, **columns) -> pa.Table:
        return pa.table({c: pa.array(columns[c]).cast(k) if c in columns else pa.nulls(n, k)
                         for c, k in zip(names, kinds, strict=True)})

    rows, out = table.to_pylist(), [piece(0)]
    for size in (1, 2):
        some = [r for r in rows if r["size"] == size]
        if not some:
            continue
        values, counts, _ = _summed(some)
        if size == 1:
            gram = mix(values + _STEP[0])
            out.append(piece(1, vocabulary=[len(counts)], once=[int((counts == 1).sum())], tokens=[int(counts.sum())]))
        else:
            often = counts >= LEAST
            gram, counts = values[often] << np.uint64(DROPPED), counts[often]
        out.append(piece(len(gram), gram=gram.view(np.int64), size=np.full(len(gram), size), count=counts))
    return pa.concat_tables(out)


class Lookup:
    """Positions of hashes in a sorted array, by their first bits; a bit map rules out most others cheaply."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values = values
        count = np.bincount(self._bits(values), minlength=1 << self.BITS)
        self.map, self.most = count > 0, int(count.max())
        self.start = (np.cumsum(count) - count).astype(np.int32)

    def _bits(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``g`` that are known, and their positions."""
        bits = self._bits(g)
        at = np.flatnonzero(self.map[bits])
        if not len(at):
            return at, at
        # Values of equal first bits lie side by side in order: go on while the one met is smaller.
        sought, position = g[at], self.start[bits[at]].astype(np.int64)
        left = np.arange(len(at))
        for _ in range(self.most - 1):
            left = left[self.values[position[left]] < sought[left]]
            if not len(left):
                break
            position[left] = np.minimum(position[left] + 1, len(self.values) - 1)
        good = self.values[position] == sought
        return at[good], position[good]


@dataclass(frozen=True)
class Bits:
    """A set of hashes as a bit map of bounded size: never misses a member, and passes some others."""

    size: int
    words: np.ndarray

    MOST = 27

    @classmethod
    def of(cls, hashes: DataFrame, column: str = "gram") -> Bits:
        """The map of a column; only its bits travel to the driver, 16 MB at most."""
        size = min(cls.MOST, max(12, (16 * hashes.count()).bit_length()))
        bit = F.shiftrightunsigned(F.col(column), 64 - size)
        found = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(
            F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({column}, {64 - size}) & 63 as int)))").alias("bits")).toArrow()
        words = np.zeros(1 << (size - 6), np.uint64)
        words[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(size, words)

    def has(self, g: np.ndarray) -> np.ndarray:
        bit = g >> np.uint64(64 - self.size)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


FOUND = "gram bigint, context bigint, shorter bigint, next bigint, size int, count bigint"
TOTALS = "gram bigint, first bigint, context bigint, shorter bigint, size int, count bigint"


def candidates(rows: DataFrame, often: DataFrame, ranges: int, parts: int = 2, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Counts by task of sequences of these sizes, of which every ``parts`` words in a row are in the bit map of ``often``.

    Only hashes and first words are sent: the hash without the first word follows from both.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Bits.of(often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = shared.value, WordHashes()
        pools = [_Pool(size, ranges, True) for size in sizes]
        for batch in batches:
            for part in _chunks(batch):
                flat, place, _ = _places(_binary(part.column(0)), hashes)
                g = grams(flat, place, max(sizes) - 1)
                fine = bits.has(g[parts - 1]) & (place >= parts - 1)
                for size, pool in zip(sizes, pools, strict=True):
                    whole = fine & (place >= size - 1)
                    for k in range(1, size - parts + 1):
                        whole[k:] &= fine[:len(fine) - k]
                    at = np.flatnonzero(whole)
                    yield from pool.add(g[size - 1][at], flat[at - (size - 1)])
        for pool in pools:
            yield from pool.flush()

    return rows.where(~F.col("held")).select("text").mapInArrow(run, GATHERED)


def sequences(rows: DataFrame, often: DataFrame, ranges: int = 12) -> DataFrame:
    """All sequences of the least count or more in training: gram, context, shorter, next, size, count.

    ``often``: words, and pairs that may have that count (gram, size, count), whose bit map no sequence of
    that count fails; each is summed over the corpus before its count is tested. Four words are only counted
    where the three before and after are frequent, which one more pass tells. Contexts and last words of
    longer sequences are read off the shorter sequence, which counts no less. The result is made of tables
    in the shared folder.
    """
    names, total_names = [[c.split()[0] for c in x.split(", ")] for x in (FOUND, TOTALS)]

    def total(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for size in range(2, DEPTH + 2):
            some = [r for r in rows if r["size"] == size]
            if not some:
                continue
            gram, counts, first = _summed(some)
            often = counts >= LEAST
            gram, counts = gram[often], counts[often]
            words = np.concatenate([_from_steps(r["c"])[_from_planes(r["d"], np.uint32)] for r in some])[first[often]]
            columns = [gram, words, mix(words + _STEP[0]), _without(words, gram)]
            columns = [pa.array(c.view(np.int64)) for c in columns]
            # Of a pair the first word is the context; longer ones find theirs by the shorter sequence.
            columns[1 if size == 2 else 2] = pa.nulls(len(gram), pa.int64())
            out.append(pa.table([*columns, pa.array(np.full(len(gram), size, np.int32)), pa.array(counts)], total_names))
        return pa.concat_tables(out)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, inner = [batch.column(c).to_numpy().view(np.uint64) for c in ("first", "inner")]
            context = pa.array(_before(first, inner).view(np.int64))
            yield pa.RecordBatch.from_arrays([context if c == "context" else batch.column(c) for c in names], names)

    def summed(sent: DataFrame) -> DataFrame:
        return written(sent.repartition(ranges, "part").groupBy("part").applyInArrow(total, TOTALS))

    totals = summed(candidates(rows, often.where("size = 2"), ranges))
    none = F.lit(0).cast("long")
    level = totals.where("size = 2").select("gram", "context", "shorter", F.col("shorter").alias("next"), "size", "count")
    found = often.where("size = 1").where(F.col("count") >= LEAST).select(
        "gram", none.alias("context"), none.alias("shorter"), none.alias("next"), "size", "count").unionByName(level)
    for size in range(3, DEPTH + 2):
        shorter = level.select(F.col("gram").alias("shorter"), F.col("context").alias("inner"), "next")
        if size > 3:
            totals = summed(candidates(rows, level, ranges, size - 1, (size,)))
        level = written(totals.where(F.col("size") == size).drop("context").join(shorter, "shorter").mapInArrow(contexts, FOUND))
        found = found.unionByName(level)
    return found


@dataclass(frozen=True)
class Tree:
    """States beyond the root: per depth sorted contexts with the log of their discount, and sorted
    sequences with the log10 ratio of their probability to that of the root."""

    contexts: tuple[np.ndarray, ...]
    discounts: tuple[np.ndarray, ...]
    sequences: tuple[np.ndarray, ...]
    ratios: tuple[np.ndarray, ...]


def grow(sequences: dict[str, np.ndarray], counts: dict[int, int], tokens: int, unseen: float) -> Tree:
    """Retain contexts by divergence from their longest shorter state: ``weights`` in memory, to compare with."""
    price = 0.5 * math.log(max(tokens, 2))
    ratio: dict[int, float] = {}     # sequence -> natural log of p(word | context) / p(word | root)
    discount: dict[int, float] = {}  # context -> natural log of what is left to the shorter state
    parts = {int(g): (int(c), int(s), int(k)) for g, c, s, k in zip(
        *[sequences[x].tolist() for x in ("gram", "context", "shorter", "size")], strict=True)}

    def value(gram: int) -> float:
        """Log ratio to the root of the last word, in the longest state of the words before it."""
        left = 0.0
        while gram in parts and parts[gram][2] > 1:
            if gram in ratio:
                return left + ratio[gram]
            left += discount.get(parts[gram][0], 0.0)
            gram = parts[gram][1]
        return left

    at_depth = []
    for depth in range(1, DEPTH + 1):
        here = np.flatnonzero(sequences["size"] == depth + 1)
        here = here[np.argsort(sequences["context"][here], kind="stable")]
        groups = np.split(here, np.flatnonzero(np.diff(sequences["context"][here])) + 1) if len(here) else []
        contexts, kept = {}, {}
        for rows in groups:
            context = int(sequences["context"][rows[0]])
            total = counts.get(context, 0)
            grams_, words = sequences["gram"][rows].tolist(), sequences["next"][rows].tolist()
            n = np.array([counts.get(g, 0) for g in grams_], float)
            if total <= 0 or not n.any():
                continue
            p = np.maximum(n - DISCOUNT, 0.01) / total
            base = np.array([math.log((1 - unseen) * max(counts.get(w, 1), 1) / tokens) for w in words])
            before = np.array([value(s) for s in sequences["shorter"][rows].tolist()]) + base
            rest, rest_before = 1 - p.sum(), 1 - np.exp(before).sum()
            if rest <= 0 or rest_before <= 1e-9:
                continue
            gain = (n * (np.log(p) - before)).sum() + (total - n.sum()) * math.log(rest / rest_before)
            if gain >= price * (len(rows) + 1):
                contexts[context] = math.log(rest / rest_before)
                kept |= dict(zip(grams_, (np.log(p) - base).tolist(), strict=True))
        discount |= contexts
        ratio |= kept
        at_depth.append((contexts, kept))

    def ordered(found: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(np.array(list(found), np.uint64))
        return keys, np.array([found[int(k)] for k in keys]) / math.log(10)

    states, longer = [ordered(c) for c, _ in at_depth], [ordered(k) for _, k in at_depth]
    return Tree(tuple(c for c, _ in states), tuple(d for _, d in states), tuple(s for s, _ in longer), tuple(r for _, r in longer))


def weights(found: DataFrame, tokens: int, unseen: float) -> tuple[DataFrame, int]:
    """What each sequence of a text adds to its log10 score (gram, weight, count), and the number of states.

    A context that is a state adds its discount wherever it occurs, as some symbol follows; a sequence
    that it stores adds what its probability differs from the discounted one of the shorter state.
    Every shorter form of a sequence is in ``found`` too, as it occurs no less often.
    """
    price = 0.5 * math.log(max(tokens, 2))
    words = found.where("size = 1").select(F.col("gram").alias("next"), F.col("count").alias("times"))
    value, parts, states = None, [], 0
    for depth in range(1, DEPTH + 1):
        rows = found.where(F.col("size") == depth + 1).select("gram", "context", "shorter", "next", F.col("count").alias("n"))
        totals = found.where(F.col("size") == depth).select(F.col("gram").alias("context"), F.col("count").alias("total"))
        rows = rows.join(totals, "context").join(words, "next")
        rows = rows.withColumn("below", F.lit(0.0)) if value is None else rows.join(
            value.select(F.col("gram").alias("shorter"), F.col("value").alias("below")), "shorter")
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.01)) / F.col("total")
        base = F.log(F.lit(1 - unseen) * F.col("times") / F.lit(float(max(tokens, 1))))
        rows = written(rows.select("gram", "context", "n", "total", "below", F.log(p).alias("p"), base.alias("base")))
        before = F.col("below") + F.col("base")
        kept = rows.groupBy("context").agg(
            F.count("*").alias("k"), F.first("total").alias("total"), F.sum("n").alias("sum_n"),
            (1 - F.sum(F.exp("p"))).alias("rest"), (1 - F.sum(F.exp(before))).alias("rest_before"),
            F.sum(F.col("n") * (F.col("p") - before)).alias("gain")).where("rest > 0 and rest_before > 1e-9").withColumn(
            "discount", F.log(F.col("rest") / F.col("rest_before"))).where(
            F.col("gain") + (F.col("total") - F.col("sum_n")) * F.col("discount") >= price * (F.col("k") + 1))
        kept = written(kept.select("context", "total", "discount"))
        states += kept.count()
        value = written(rows.join(kept.select("context", "discount"), "context", "left").select(
            "gram", "n", "discount", "below",
            F.when(F.col("discount").isNull(), F.col("below")).otherwise(F.col("p") - F.col("base")).alias("value")))
        parts += [kept.select(F.col("context").alias("gram"), F.col("discount").alias("weight"), F.col("total").alias("count")),
                  value.where("discount is not null").select(
                      "gram", (F.col("value") - F.col("below") - F.col("discount")).alias("weight"), F.col("n").alias("count"))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return written(every.groupBy("gram").agg(
        (F.sum("weight") / math.log(10)).alias("weight"), F.max("count").alias("count"))), states


def hot_count(weighed: DataFrame) -> int:
    """A power of two: the least one for which at most HOT sequences occur so often."""
    level = F.floor(F.log2("count")).cast("int").alias("level")
    room, cut = HOT, 0
    for r in sorted(weighed.groupBy(level).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            cut = r["level"] + 1
            break
    return 1 << cut


def _hot(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    values, order = np.unique(table["gram"].to_numpy().astype(np.int64).view(np.uint64), return_index=True)
    return values, table[column].to_numpy().astype(float)[order]


class _Hot:
    """What hot weights (gram, weight) add to texts, and the hot words (gram, count) of these."""

    def __init__(self, weights: pa.Table, words: pa.Table):
        grams_, self.weight = _hot(weights, "weight")
        known, counts = _hot(words, "count")
        self.lookup, self.counted = Lookup(grams_), Lookup(known)
        self.logs, self.halves = np.log10(counts), np.log10(counts + 0.5)

    def sums(self, g: list[np.ndarray], place: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Of each text: weights, logs of counts, logs of counts and a half, known words."""
        sums = np.zeros((4, len(place)))
        for k, longer in enumerate(g):
            at, position = self.lookup.find(longer)
            real = place[at] >= k
            sums[0, at[real]] += self.weight[position[real]]
        at, position = self.counted.find(g[0])
        sums[1, at], sums[2, at], sums[3, at] = self.logs[position], self.halves[position], 1
        return list(np.add.reduceat(sums, np.cumsum(lengths) - lengths, axis=1) if len(lengths) else np.zeros((4, 0)))


SUMMED = "key bigint, held boolean, n_tokens bigint, gain double, logs double, halves double, known double"


def _read(part: pa.RecordBatch, hashes: WordHashes):
    flat, place, lengths = _places(_binary(part.column(1)), hashes)
    return grams(flat, place, DEPTH), place, lengths


def adjustments(rows: DataFrame, hot: DataFrame, id_col: str, words: DataFrame | None = None) -> DataFrame:
    """(id, key, held, n_tokens, gain, logs, halves, known): the sum of the hot weights of each text, and of its hot
    ``words`` (gram, count) the logs of their counts, those of the counts and a half, and their number."""
    words = hot.where("false").withColumn("count", F.lit(0)) if words is None else words
    shared = rows.sparkSession.sparkContext.broadcast((hot.toArrow(), words.toArrow()))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = _Hot(*shared.value), WordHashes()
        for batch in batches:
            for part in _chunks(batch):
                g, place, lengths = _read(part, hashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), part.column(0), part.column(2), pa.array(lengths), *map(pa.array, known.sums(g, place, lengths))],
                    ["id", "key", "held", "n_tokens", "gain", "logs", "halves", "known"])

    return rows.select("key", "text", "held", F.col(id_col).alias("id")).mapInArrow(run, f"id {kind}, {SUMMED}")


def with_cold(rows: DataFrame, hot: DataFrame, id_col: str, words: DataFrame, cold: DataFrame, ranges: int) -> DataFrame:
    """``adjustments`` with the sums over all other weights and words in them, a row for each row of the corpus.

    ``cold``: gram, weight, and the count of a word or 0. Places that may be cold are dealt by range of hashes, packed
    with the number of their text, and meet the weights of the range there; texts pass the same step beside them.
    """
    context = rows.sparkSession.sparkContext
    shared, maybe = context.broadcast((hot.toArrow(), words.toArrow())), context.broadcast(Bits.of(cold))
    kind = rows.schema[id_col].dataType.simpleString()
    numbers = ("gain", "logs", "halves", "known")
    sums = pa.schema([("id", rows.select(id_col).limit(0).toArrow().schema.field(0).type), ("key", pa.int64()), ("held", pa.bool_()),
                      ("n_tokens", pa.int64()), *[(c, pa.float64()) for c in numbers]])
    whole = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in "abc"], *sums])

    def lines(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, hashes = _Hot(*shared.value), maybe.value, WordHashes()
        keys, found, texts, held = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            g, text = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = np.argsort(g)
            g, text, names = g[order], text[order], np.concatenate(keys).tobytes()
            for r, at in _by_part(_range(g, ranges), ranges):
                cells = (_steps(g[at]), _planes(text[at]), names)
                yield lines(whole, 1, part=pa.array([r], pa.int32()), **{
                    c: pa.array([x], pa.binary()) for c, x in zip("abc", cells, strict=True)})

        for batch in batches:
            for part in _chunks(batch):
                g, place, lengths = _read(part, hashes)
                key = part.column(0).to_numpy()
                yield lines(whole, len(key), part=pa.array((key.view(np.uint64) % np.uint64(ranges)).astype(np.int32)),
                            id=part.column(3), key=part.column(0), held=part.column(2), n_tokens=pa.array(lengths),
                            **dict(zip(numbers, map(pa.array, known.sums(g, place, lengths)), strict=True)))
                text = np.repeat(np.arange(texts, texts + len(key), dtype=np.uint32), lengths)
                keys.append(key)
                texts += len(key)
                for k, longer in enumerate(g):
                    at = np.flatnonzero(bits.has(longer) & (place >= k))
                    found.append((longer[at], text[at]))
                    held += len(at)
                if held > POOL // 4:
                    yield from flush()
                    keys, found, texts, held = [], [], 0, 0
        if found:
            yield from flush()

    def meet(places: pa.Table, weights: pa.Table) -> pa.Table:
        grams_, weight, times = [weights[c].to_numpy() if weights.num_rows else np.zeros(0, k) for c, k in (
            ("gram", np.int64), ("weight", float), ("times", np.int64))]
        order = np.argsort(grams_.view(np.uint64))
        grams_, weight, times = grams_.view(np.uint64)[order], weight[order], times[order]
        if len(grams_):
            # A word may have a count and, as a context, a weight.
            new = np.flatnonzero(np.r_[True, grams_[1:] != grams_[:-1]])
            grams_, weight, times = grams_[new], np.add.reduceat(weight, new), np.add.reduceat(times, new)
        word = times > 0
        logs, halves = np.log10(np.maximum(times, 1)), np.log10(times + 0.5) * word
        out, cells = [sums.empty_table()], []
        if places.num_rows:
            out.append(places.filter(places["a"].is_null()).select(sums.names).cast(sums))
            cells = np.flatnonzero(places["a"].is_valid().to_numpy()).tolist()
        for n in cells if len(grams_) else []:
            a, b, c = [places[x][n].as_py() for x in "abc"]
            g, text, keys = _from_steps(a), _from_planes(b, np.uint32), np.frombuffer(c, np.int64)
            position = np.minimum(np.searchsorted(grams_, g), len(grams_) - 1)
            good = grams_[position] == g
            position, text = position[good], text[good]
            have = np.flatnonzero(np.bincount(text, minlength=len(keys)))
            found = [np.bincount(text, weights=x[position], minlength=len(keys))[have] for x in (weight, logs, halves, word)]
            out.append(pa.Table.from_batches([lines(sums, len(have), key=pa.array(keys[have]), **dict(zip(
                numbers, map(pa.array, found), strict=True)))]))
        return pa.concat_tables(out)

    part = (F.shiftrightunsigned("gram", 40) % ranges).cast("int")
    summed = f"id {kind}, {SUMMED}"
    dealt = rows.select("key", "text", "held", F.col(id_col).alias("id")).mapInArrow(
        run, f"part int, a binary, b binary, c binary, {summed}").groupBy("part").cogroup(
        cold.withColumn("part", part).groupBy("part")).applyInArrow(meet, summed)
    # Rows of equal id and text share their key and are alike.
    copies = F.count("n_tokens")
    return dealt.groupBy("key").agg(
        copies.alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("id", "held", "n_tokens")],
        *[(F.sum(c) / copies).alias(c) for c in numbers]).select(
        "id", "key", "held", "n_tokens", *numbers, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, states.

    Null and empty texts are one end symbol. Whole texts count and are scored; repeated rows each get
    their row and count in training each; a null id is the empty text to the split. Where no row is in
    training, every word is unseen: base_score then is that of zero counts and score takes all mass for
    the unseen symbol. An empty table gives an empty result; other columns are ignored.
    """
    light_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "key", F.xxhash64(F.col(id_col), F.col("text"))).withColumn("held", held_out(F.col(id_col)))
    rows = rows.select("key", "text", "held", id_col)
    letters = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(12, round(letters / 6 / RANGE))
    with freed_shuffles(docs.sparkSession):
        sums = written(gather(rows.select("key", "text", "held"), ranges).repartition(ranges, "part").groupBy("part").applyInArrow(
            _sums, SUMS))
        totals = sums.where("gram is null").agg(*[F.sum(c).alias(c) for c in ("vocabulary", "tokens", "once")]).first()
        size, tokens, once = (totals[c] or 0 for c in ("vocabulary", "tokens", "once"))
        unseen = min(0.5, max(once, 0.5) / tokens) if tokens else 1.0
        found = sequences(rows, sums.where("gram is not null").select("gram", "size", "count"), ranges)
        weighed, states = weights(found, tokens, unseen)
    words = sums.where("size = 1").select("gram", "count")
    cut, cut_words = hot_count(weighed), hot_count(words)
    hot, hot_words = weighed.where(F.col("count") >= cut), words.where(F.col("count") >= cut_words)
    cold = weighed.where(F.col("count") < cut).select("gram", "weight", F.lit(0).cast("long").alias("times")).unionAll(
        words.where(F.col("count") < cut_words).select("gram", F.lit(0.0).alias("weight"), F.col("count").alias("times")))
    per = adjustments(rows, hot, id_col, hot_words) if cold.isEmpty() else with_cold(
        rows, hot, id_col, hot_words, cold, max(12, ranges // 10))
    known = F.round("known").cast("long")
    new = F.col("n_tokens") - known
    seen = math.log10((1 - unseen) / tokens) if tokens and unseen < 1 else 0.0
    return per.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", known.alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("halves") + new * math.log10(0.5)
         - F.col("n_tokens") * math.log10(tokens + 0.5 * (size + 1))).alias("base_score"),
        (F.col("logs") + known * seen + new * math.log10(unseen) + F.col("gain")).alias("score"),
        F.lit(states).cast("int").alias("states"))
