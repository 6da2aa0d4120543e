"""Turn raw columns into numbers, business timestamps and dimension members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.contract import NULL_MEMBER, Measure
from measureloom.functions import timeforms

# Characters dropped from text numbers.
NUMBER_NOISE = r"[,¥￥]"
# An offset stands after a time of day only: in 5-Jan-2025 or 01-12-2025 the end is a year.
OFFSET_PATTERN = r"(?i)\d:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$"
BLANK = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
_PERHAPS_NUMBER = r"^[0-9+\-.eE,¥￥()" + BLANK[1:-2] + r"]+\z"


def stripped(c: Column) -> Column:
    """Text without white space, of any script, at its ends."""
    return F.regexp_replace(c, f"^{BLANK}|{BLANK}$", "")


def text_number(c: Column) -> Column:
    """Text to double: trim, drop commas and currency signs, ``(x)`` is ``-x``, else null.

    Plain numbers are read at once, and texts with a character that no number has are given up at it.
    """
    bare = F.regexp_replace(stripped(c), NUMBER_NOISE, "")
    signed = stripped(F.regexp_replace(bare, r"^\((.*)\)$", "-$1"))
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double")).when(
        c.rlike(_PERHAPS_NUMBER), F.when(signed.rlike(_PLAIN_NUMBER), signed.try_cast("double")))


def finite(c: Column) -> Column:
    """NaN becomes null so that it never counts as an observation."""
    return F.when(~F.isnan(c), c)


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a nullable double, whatever its stored type."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return text_number(c.cast("string"))


def has_offset(df: DataFrame, name: str) -> Column:
    """True where a text timestamp carries a UTC offset."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(stripped(F.col(f"`{name}`")).rlike(OFFSET_PATTERN), F.lit(False))
    return F.lit(False)


def timestamp(df: DataFrame, name: str, timezone: str | None = None) -> Column:
    """Column ``name`` as business wall-clock time; unparsable text is null.

    Text with an offset is moved to ``timezone`` (UTC when none is declared); text without one is
    taken as business time already. Stored instants are moved to ``timezone`` when one is declared;
    dates and timestamps without zone are business time already.
    """
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType) and timezone:
        return F.convert_timezone(
            F.current_timezone(), F.lit(timezone), c.cast("timestamp_ntz")).cast("timestamp")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    return timeforms.moment(stripped(c.cast("string")), timezone)


def row_value(df: DataFrame, measure: Measure) -> Column:
    """One row's value of a measure in its declared scale."""
    if measure.aggregation == "ratio":
        top, bottom = number(df, measure.numerator_field), number(df, measure.denominator_field)
        value = top / F.when(bottom > 0, bottom)
        return value * 100 if measure.unit == "percent" else value
    return storage_scaled(number(df, measure.field), measure)


def storage_scaled(value: Column, measure: Measure) -> Column:
    """Fractions shown in percent are multiplied by 100, everything else is left alone."""
    scaled = measure.storage_scale == "fraction" and measure.unit == "percent"
    return value * 100 if scaled else value


def source_present(measure: Measure) -> Column:
    """True where the source cell (or either ratio input) is filled at all."""
    if measure.aggregation == "ratio":
        return (F.col(f"`{measure.numerator_field}`").isNotNull()
                | F.col(f"`{measure.denominator_field}`").isNotNull())
    return F.col(f"`{measure.field}`").isNotNull()


def member(c: Column) -> Column:
    """Dimension member as text, with a label for null."""
    return F.coalesce(c.cast("string"), F.lit(NULL_MEMBER))


def filled_text(c: Column) -> Column:
    """True where an object column holds something other than blanks."""
    return c.isNotNull() & (F.trim(c.cast("string")) != "")
