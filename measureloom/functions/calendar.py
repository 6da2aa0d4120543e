"""Calendar periods as column expressions: keys, label resolution, comparison windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measureloom.contract import COMPARISON_GRANULARITY, COMPARISONS, TIME_COMPARISONS

FREQUENCIES = ("period", "xun", "week", "month", "quarter", "half", "year")
WHOLE_PERIOD = "locked-period"  # fixed value: key of an unsplit period


def xun_part(day: Column) -> Column:
    """1, 2 or 3: the ten-day third of the month a date falls in."""
    d = F.dayofmonth(day)
    return F.when(d <= 10, 1).when(d <= 20, 2).otherwise(3)


def half_of(day: Column) -> Column:
    return F.when(F.month(day) <= 6, 1).otherwise(2)


def period_key(day: Column, frequency: str) -> Column:
    """Text key of the calendar period that holds ``day``."""
    y = F.year(day).cast("string")
    if frequency == "period":
        return F.lit(WHOLE_PERIOD)
    if frequency == "xun":
        key = F.concat(F.date_format(day, "yyyy-MM"), F.lit("-X"), xun_part(day).cast("string"))
    elif frequency == "week":
        week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
        key = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), week)
    elif frequency == "month":
        key = F.date_format(day, "yyyy-MM")
    elif frequency == "quarter":
        key = F.concat(y, F.lit("Q"), F.quarter(day).cast("string"))
    elif frequency == "half":
        key = F.concat(y, F.lit("-H"), half_of(day).cast("string"))
    elif frequency == "year":
        key = y
    else:
        raise ValueError(f"frequency {frequency!r} not one of {FREQUENCIES}")
    return F.when(day.isNotNull(), key)


def month_index(day: Column) -> Column:
    """Running month number, so that adjacent months differ by one."""
    return F.year(day) * 12 + F.month(day)


def month_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per month from ``start`` to ``end`` (dates inside the first and last month)."""
    first, last = (F.trunc(F.lit(d).cast("date"), "month") for d in (start, end))
    return spark.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))


# Spellings of a period label (white space dropped, letters upper-cased, number words
# turned into digits) and the canonical text of each.
_SPELLINGS = (
    (r"^(\d{4})[-年]?Q([1-4])$", "$1Q$2"),
    (r"^(\d{4})年?第?([1-4])季度$", "$1Q$2"),
    (r"^(\d{4})[-年]?H([12])$", "$1H$2"),
    (r"^(\d{4})年?上半年$", "$1H1"),
    (r"^(\d{4})年?下半年$", "$1H2"),
    (r"^(\d{4})[-年]?W(\d{1,2})$", "$1W$2"),
    (r"^(\d{4}[-年]\d{1,2})月?-?上旬$", "$1X1"),
    (r"^(\d{4}[-年]\d{1,2})月?-?中旬$", "$1X2"),
    (r"^(\d{4}[-年]\d{1,2})月?-?下旬$", "$1X3"),
    (r"^(\d{4}[-年]\d{1,2})月?-?(?:X([123])|([123])旬)$", "$1X$2$3"),
    (r"^(\d{4})年(\d{1,2})", "$1-$2"),
    (r"^(\d{4}-\d{1,2})月$", "$1"),
    (r"^(\d{4})[-年]?全年$", "$1"),
)
_NUMBER_WORDS = ("一二三四", "1234")
_CANONICAL = r"^(\d{4})(?:-(\d{1,2}))?(?:([QHWX])(\d{1,2}))?$"
_RANGE = r"^(\d{4}-\d{1,2}-\d{1,2})(?:\.\.|~|至)(\d{4}-\d{1,2}-\d{1,2})$"
# Fixed value: a label that matches this was never filled in.
PLACEHOLDER = r"(?i)^(|auto|latest|最新|自动)$|填写|示例|待填|yyyy"


def is_placeholder(label: Column) -> Column:
    """True for an empty or template label, which asks for the latest year to date."""
    return F.coalesce(F.trim(label).rlike(PLACEHOLDER), F.lit(True))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _make(y: Column, m: Column, d: int) -> Column:
    inside = m.between(1, 12)
    return F.when(inside, F.make_date(y, F.when(inside, m), F.lit(d)))


def _day_of(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def canonical_label(label: Column) -> Column:
    """Normal spelling of a period label."""
    text = F.translate(F.upper(F.regexp_replace(label, r"\s+", "")), *_NUMBER_WORDS)
    for pattern, plain in _SPELLINGS:
        text = F.regexp_replace(text, pattern, plain)
    return text


def period_bounds(label: Column) -> Column:
    """Resolve a period label to ``struct(start, end, granularity, label)``; null if unreadable.

    Whole columns of labels resolve in one projection, so a table of thousands of period
    specifications needs no lookup and no driver loop.
    """

    def parts(text: Column) -> Column:
        def int_part(group: int) -> Column:
            return F.regexp_extract(text, _CANONICAL, group).try_cast("int")

        return F.struct(
            int_part(1).alias("y"), int_part(2).alias("m"), int_part(4).alias("n"),
            F.regexp_extract(text, _CANONICAL, 3).alias("mark"),
            _day_of(F.regexp_extract(text, _RANGE, 1)).alias("from"),
            _day_of(F.regexp_extract(text, _RANGE, 2)).alias("upto"))

    def starts(p: Column) -> Column:
        y, m, n, mark = p["y"], p["m"], p["n"], p["mark"]
        monday = F.date_add(F.to_date(F.date_trunc("week", _make(y, F.lit(1), 4))), (n - 1) * 7)
        start = (
            F.when(p["from"].isNotNull(), p["from"])
            .when(mark == "Q", _make(y, n * 3 - 2, 1))
            .when(mark == "H", _make(y, n * 6 - 5, 1))
            .when((mark == "W") & m.isNull() & (F.weekofyear(monday) == n) & (n > 0), monday)
            .when((mark == "X") & m.isNotNull(), F.date_add(_make(y, m, 1), (n - 1) * 10))
            .when((mark == "") & m.isNotNull(), _make(y, m, 1))
            .when((mark == "") & y.isNotNull(), _make(y, F.lit(1), 1)))
        return F.struct(p.alias("p"), start.alias("start"))

    def bounds(s: Column) -> Column:
        p, start = s["p"], s["start"]
        mark, n, y = p["mark"], p["n"], p["y"].cast("string")
        end = (
            F.when(p["from"].isNotNull(), p["upto"])
            .when(mark == "Q", F.last_day(F.add_months(start, 2)))
            .when(mark == "H", F.last_day(F.add_months(start, 5)))
            .when(mark == "W", F.date_add(start, 6))
            .when((mark == "X") & (n < 3), F.date_add(start, 9))
            .when((mark == "X") | p["m"].isNotNull(), F.last_day(start))
            .otherwise(_make(p["y"], F.lit(12), 31)))
        kind = (
            F.when(p["from"].isNotNull(), "custom").when(mark == "Q", "quarter")
            .when(mark == "H", "half").when(mark == "W", "week").when(mark == "X", "xun")
            .when(p["m"].isNotNull(), "month").otherwise("year"))
        name = (
            F.when(p["from"].isNotNull(), F.concat(
                p["from"].cast("string"), F.lit(".."), p["upto"].cast("string")))
            .when(mark.isin("Q", "H"), F.concat(y, mark, n.cast("string")))
            .when(mark == "W", F.concat(y, F.lit("-W"), F.lpad(n.cast("string"), 2, "0")))
            .when(mark == "X", F.concat(F.date_format(start, "yyyy-MM"), F.lit("-X"),
                                        n.cast("string")))
            .when(p["m"].isNotNull(), F.date_format(start, "yyyy-MM")).otherwise(y))
        return F.struct(start.alias("start"), end.alias("end"), kind.alias("granularity"),
                        name.alias("label"))

    found = _let(canonical_label(label), lambda t: _let(
        parts(t), lambda p: _let(starts(p), bounds)))
    return _let(found, lambda f: F.when(
        f["start"].isNotNull() & f["end"].isNotNull() & (f["start"] <= f["end"]), f))


def inferred_bounds(last_day: Column, granularity: str) -> Column:
    """Latest year to date: January 1st to the end of the last month (or ten-day third) seen."""
    month_first = F.to_date(F.trunc(last_day, "month"))
    end = F.last_day(last_day)
    if granularity == "xun":
        end = (F.when(F.dayofmonth(last_day) <= 10, F.date_add(month_first, 9))
               .when(F.dayofmonth(last_day) <= 20, F.date_add(month_first, 19)).otherwise(end))
    return F.struct(
        F.to_date(F.trunc(last_day, "year")).alias("start"), end.alias("end"),
        F.lit(granularity).alias("granularity"),
        F.concat(F.year(last_day).cast("string"), F.lit("YTD")).alias("label"))


def comparison_matches(comparison: str, granularity: Column) -> Column:
    """False where a spelling such as ``mom`` is used on a period of another granularity."""
    wanted = COMPARISON_GRANULARITY.get(comparison)
    return granularity == wanted if wanted else F.lit(True)


def baseline_window(
    comparison: str, start: Column, end: Column, granularity: Column,
    custom: Column | None = None,
) -> Column:
    """``struct(start, end)`` of the baseline of a comparison; null when there is none."""
    kind = COMPARISONS[comparison]
    if kind not in TIME_COMPARISONS:
        return F.lit(None).cast("struct<start:date,end:date>")

    def window(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("end"))

    day_before = F.date_sub(start, 1)
    equal = window(F.date_sub(start, F.datediff(end, start) + 1), day_before)
    if kind == "year_over_year":
        found = window(F.add_months(start, -12), F.add_months(end, -12))
    elif kind in ("period_over_period", "previous_equal_window"):
        found = equal
    elif kind == "custom":
        if custom is None:
            raise ValueError("a custom comparison needs a baseline period")
        found = F.when(custom.isNotNull(), window(custom["start"], custom["end"]))
    else:
        half_start = F.make_date(
            F.year(day_before), F.when(F.month(day_before) <= 6, 1).otherwise(7), F.lit(1))
        found = (
            F.when(granularity == "month", window(F.to_date(F.trunc(day_before, "month")), day_before))
            .when(granularity == "week", window(F.date_sub(start, 7), day_before))
            .when(granularity == "quarter",
                  window(F.to_date(F.trunc(day_before, "quarter")), day_before))
            .when(granularity == "half", window(half_start, day_before))
            .when(granularity == "year",
                  window(F.make_date(F.year(start) - 1, F.lit(1), F.lit(1)),
                         F.make_date(F.year(start) - 1, F.lit(12), F.lit(31))))
            .otherwise(equal))
    return F.when(comparison_matches(comparison, granularity), found)


def period_display(day: Column, granularity: Column) -> Column:
    """Short label of the period that starts at ``day``."""
    y = F.year(day).cast("string")
    return (
        F.when(granularity == "month", F.date_format(day, "yyyy-MM"))
        .when(granularity == "quarter",
              F.concat(y, F.lit("Q"), F.quarter(day).cast("string")))
        .when(granularity == "half", F.concat(y, F.lit("H"), half_of(day).cast("string")))
        .when(granularity == "year", y)
        .otherwise(day.cast("string")))
