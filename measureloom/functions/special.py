"""Special functions Spark does not ship."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a published Chebyshev fit of the complementary error function
# (fractional error below 1.2e-7 everywhere).
_FIT = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative column."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(_FIT[-1])
    for coefficient in reversed(_FIT[:-1]):
        poly = F.lit(coefficient) + t * poly
    return t * F.exp(-x * x + poly)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value of a z score."""
    return erfc(F.abs(z) / F.lit(2.0 ** 0.5))


def half_even(value: Column, digits: int) -> Column:
    """Round half to even, the way contract outputs are printed."""
    return F.bround(value, digits)
