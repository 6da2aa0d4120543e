"""Sums that come out the same whatever order the rows arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# From here up doubles have no decimals left; a whole has ten thousand parts.
_WHOLE = float(1 << 52)
_PARTS = 10_000.0


def steady_sum(value: Column) -> Column:
    """Sum of doubles as an aggregate; equal values give equal sums, so ties stay ties.

    A value is cut into its whole, ten-thousandths and the rest. Wholes and parts add up without
    any rounding while their sums stay below 2^53, so amounts of up to four decimals have their
    exact sum. Rests are summed as they are, far below the last digit of such a sum. Beyond 2^53,
    and for values below a ten-thousandth, this rounds like a plain sum.
    """
    return joined(*[F.sum(piece) for piece in pieces(value)])


def pieces(value: Column) -> tuple[Column, Column, Column]:
    """Whole, ten-thousandths and rest of a value; their sums may be summed again in any groups."""
    small = F.abs(value) < _WHOLE
    whole = F.when(small, F.rint(value)).otherwise(value)
    part = F.when(small, F.rint((value - F.rint(value)) * _PARTS)).otherwise(0.0)
    rest = F.when(small, value - (F.rint(value) + part / _PARTS)).otherwise(0.0)
    return whole, part, rest


def joined(wholes: Column, parts: Column, rests: Column) -> Column:
    """The sum of values from the sums of their pieces."""
    carry = F.rint(parts / _PARTS)
    return (wholes + carry) + (parts - carry * _PARTS) / _PARTS + rests
