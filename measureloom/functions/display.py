"""Show numbers as text and read shown numbers back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs that mean a sign, units a shown number may carry, and the number pattern.
_PLUS, _MINUS = "▲△↑", "▼▽↓−"
_SHOWN = r"([+-]?)([\d,]+(?:\.\d+)?)((?i:亿|万|%|pp))?"
_COUNT_UNITS = ("count", "person", "people", "ticket", "unit")


def inferred_format(path: Column, unit: Column) -> Column:
    """Display format suggested by the last path segment and the unit."""
    leaf = F.element_at(F.split(path, r"\."), -1)
    return (
        F.when(leaf.rlike(r"_pp$"), "percentage_point")
        .when(leaf.rlike(r"(share|yoy|_pct)$"), "percent")
        .when(unit.isin("percent", "percentage"), "percent")
        .when(unit.isin(*_COUNT_UNITS), "integer")
        .otherwise("decimal"))


MOST_DECIMALS = 12


def grouped_fixed(value: Column, precision: Column) -> Column:
    """Thousands separators and a fixed number of decimals (0 to 12), halves away from zero.

    More decimals than that are an error, as a double does not carry them.
    """
    size = F.abs(value)
    halves_exact = size * 1024 == F.floor(size * 1024)

    def shown(digits: int) -> Column:
        return F.format_number(F.when(halves_exact, F.round(size, digits)).otherwise(size), digits)

    text = F.raise_error(F.concat(F.lit("precision not between 0 and 12: "), precision.cast("string"))).cast("string")
    for digits in range(MOST_DECIMALS, -1, -1):
        text = F.when(precision == digits, shown(digits)).otherwise(text)
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def format_metric(value: Column, fmt: Column, precision: Column | None = None) -> Column:
    """Value as text in one of the formats integer, decimal, signed_number, percent,
    signed_percent and percentage_point. Without a precision, whole decimals show none and
    everything else shows one digit."""
    default = F.when(
        (fmt == "integer") | ((fmt == "decimal") & (value == F.floor(value))), 0).otherwise(1)
    digits = default if precision is None else F.coalesce(precision, default)
    plus = F.when(fmt.isin("signed_number", "signed_percent") & (value > 0), "+").otherwise("")
    tail = (F.when(fmt.isin("percent", "signed_percent"), "%")
            .when(fmt == "percentage_point", "pp").otherwise(""))
    return F.when(value.isNotNull(), F.concat(plus, grouped_fixed(value, digits), tail))


def format_magnitude(value: Column) -> Column:
    """Amounts in 亿 from 1e8, in 万 from 1e4 (no decimals from 1e7), plain below.

    亿 shows the stored double as it is, so 1.15, stored a little below, becomes 1.1; an exact half
    goes to the even digit. Elsewhere halves go away from zero.
    """
    size = F.abs(value)
    shown = (
        F.when(size >= 1e8, F.concat(_bare(F.format_number(size / 1e8, 1)), F.lit("亿")))
        .when(size >= 1e7, F.concat(F.format_number(F.floor(size / 1e4 + 0.5), 0), F.lit("万")))
        .when(size >= 1e4, F.concat(_bare(F.format_number(F.round(size / 1e4, 1), 1)), F.lit("万")))
        .otherwise(F.format_number(F.floor(size + 0.5), 0)))
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), shown))


def _bare(shown: Column) -> Column:
    return F.replace(shown, F.lit(","), F.lit(""))


def parse_shown(text: Column) -> Column:
    """Read a shown number: ``struct(value, unit, decimals, count)``; null when there is none."""
    signed = F.translate(
        F.regexp_replace(text, r"\s+", ""), _PLUS + _MINUS, "+" * len(_PLUS) + "-" * len(_MINUS))
    digits = F.regexp_extract(signed, _SHOWN, 2)
    magnitude = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    value = F.when(F.regexp_extract(signed, _SHOWN, 1) == "-", -magnitude).otherwise(magnitude)
    decimals = F.char_length(F.regexp_extract(digits, r"\.(\d+)$", 1))
    count = F.size(F.regexp_extract_all(signed, F.lit(_SHOWN), F.lit(0)))
    return F.when(
        count > 0,
        F.struct(value.alias("value"), F.lower(F.regexp_extract(signed, _SHOWN, 3)).alias("unit"),
                 decimals.alias("decimals"), count.alias("count")))


def unit_label(unit: Column) -> Column:
    """Display word of a unit code (fixed values), or the code itself."""
    words = {
        "currency": "元", "CNY": "元", "count": "项", "person": "人", "people": "人",
        "ticket": "单", "unit": "单位", "minute": "分钟", "point": "分", "percent": "百分比",
    }
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, unit), unit, F.lit(""))
