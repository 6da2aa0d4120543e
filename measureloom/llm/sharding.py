"""Shards of a reproducible shuffle: a keyed permutation of global row numbers.

Rows are numbered from 0 in the order of chosen columns, whatever the partitions they come in. A
Feistel network permutes the numbers; its domain is the smallest power of four that holds them all,
and a value beyond the last row is permuted again (cycle walking) until it falls among the rows. The
permuted number gives shard and slot, so both can be computed for any row number, and the row number
for any slot, without reading a table. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import before, repeated

_MASK = (1 << 31) - 1
_FIRST, _SECOND = 0x9E3779B1, 0x85EBCA6B
ROUNDS = 6
#: A walk is LAPS times LAPS applications at most; a longer one raises. Each application falls among
#: the rows with a chance of a quarter or more, so that none in 10**500 walks is longer.
LAPS = 64
MAX_ROWS = 1 << 61


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds, 31 bits each."""
    return [((seed + 1) * _FIRST + (k + 1) * _SECOND) & _MASK for k in range(rounds)]


def _mixed(value: Column, key: Column, half: int) -> Column:
    """A keyed hash of `half` bits; products of 31 and 32 bits stay within a long."""
    first = value.bitwiseXOR(key).bitwiseAND(F.lit(_MASK)) * F.lit(_FIRST)
    folded = F.shiftright(first, 16).bitwiseXOR(F.shiftright(first, 33)).bitwiseAND(F.lit(_MASK))
    return F.shiftright(folded * F.lit(_SECOND), 17).bitwiseAND(F.lit((1 << half) - 1))


def _half(total: int) -> int:
    return max(1, (max(total - 1, 0).bit_length() + 1) // 2)


def _network(value: Column, half: int, keys: list[int]) -> Column:
    low = F.lit((1 << half) - 1)
    halves = F.struct(F.shiftright(value, half).alias("left"), value.bitwiseAND(low).alias("right"))
    return F.aggregate(
        F.array(*[F.lit(k).cast("long") for k in keys]), halves,
        lambda s, key: F.struct(s["right"].alias("left"),
                                s["left"].bitwiseXOR(_mixed(s["right"], key, half)).alias("right")),
        lambda s: F.shiftleft(s["left"], half) + s["right"])


def _swapped(value: Column, half: int) -> Column:
    return F.shiftleft(value.bitwiseAND(F.lit((1 << half) - 1)), half) + F.shiftright(value, half)


def _walk(step, start: Column, total: int) -> Column:
    laps = F.sequence(F.lit(1), F.lit(LAPS))
    inside = lambda x: x < F.lit(total)
    lap = lambda x: F.aggregate(laps, x, lambda y, _: F.when(inside(y), y).otherwise(step(y)))
    lost = F.raise_error(F.lit("the walk found no row")).cast("long")
    return F.aggregate(laps, step(start), lambda x, _: F.when(inside(x), x).otherwise(lap(x)),
                       lambda x: F.when(inside(x), x).otherwise(lost))


def permuted(number: Column, total: int, seed: int) -> Column:
    """Where the permutation of 0..total-1 takes a row number; null stays null."""
    keys, half = round_keys(seed), _half(total)
    return F.when(number.isNotNull(), _walk(lambda x: _network(x, half, keys), number.cast("long"), total))


def restored(value: Column, total: int, seed: int) -> Column:
    """The row number that `permuted` takes to the value."""
    keys, half = round_keys(seed)[::-1], _half(total)
    back = lambda x: _swapped(_network(_swapped(x, half), half, keys), half)
    return F.when(value.isNotNull(), _walk(back, value.cast("long"), total))


def shard_and_slot(value: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a permuted number: shards differ by one row at most, slots have no gaps."""
    return (value % shards).cast("int"), F.call_function("div", value, F.lit(shards).cast("long"))


def number_at(shard: Column, slot: Column, total: int, shards: int, seed: int) -> Column:
    """The row number that stands at a slot of a shard."""
    return restored(slot.cast("long") * shards + shard, total, seed)


def _numbered(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Every row as a struct `_row` with its number `_n`, and how many there are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    once = rows.groupBy(whole.alias("_row")).agg(F.count(F.lit(1)).alias("_copies"))
    keys = [f"_key_{k}" for k in range(len(order))]
    once = once.select("_row", "_copies", *[F.col("_row")[c].alias(k) for c, k in zip(order, keys, strict=True)])
    placed = before(once, [], [*keys, "_row"], "_before", "_copies")
    total = placed.agg(F.max(F.col("_before") + F.col("_copies"))).first()[0] or 0
    if total > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows")
    each = repeated(placed.select("_row", "_before", "_copies"), "_copies", "_copy")
    return each.select("_row", (F.col("_before") + F.col("_copy")).alias("_n")), total


def numbered(rows: DataFrame, order: Sequence[str], number_col: str = "number") -> DataFrame:
    """The rows with their global number, 0 first, in the order of the columns.

    Nulls come first. Rows equal in the ordering columns follow the order of all their columns; rows
    equal in all columns take consecutive numbers, and are counted before anything is shuffled, so a
    row repeated very often costs no more than one. Columns have to be comparable (no maps). A column
    named as the number is replaced. An empty table has no rows.
    """
    found, _ = _numbered(rows.drop(number_col), order)
    return found.select("_row.*", F.col("_n").alias(number_col))


def assign(rows: DataFrame, order: Sequence[str], shards: int = 16, seed: int = 0, shard_col: str = "shard",
           slot_col: str = "slot") -> DataFrame:
    """The rows with shard (0 first) and slot (0 first, gapless within the shard).

    The same rows, columns, seed and number of shards give the same places, however the table is
    stored or partitioned. Texts need not take part: number a few columns that tell rows apart, join
    the rest. Columns named as shard or slot are replaced; see `numbered` for nulls and repeated rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    found, total = _numbered(rows.drop(shard_col, slot_col), order)
    placed = found.select("_row", permuted(F.col("_n"), max(total, 1), seed).alias("_value"))
    shard, slot = shard_and_slot(F.col("_value"), shards)
    return placed.select("_row.*", shard.alias(shard_col), slot.alias(slot_col))


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Write assigned rows as Parquet folders, one per shard, each file a range of slots in order."""
    placed.repartitionByRange(shard_col, slot_col).sortWithinPartitions(shard_col, slot_col).write.partitionBy(
        shard_col).parquet(path)
