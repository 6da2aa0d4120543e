"""Declared periods and their baselines as plain dates.

The same rules as the column expressions of ``calendar``, for the one label of a scope: it is
configuration, and resolving it needs no job. Tables of labels use the column form.
"""

from __future__ import annotations

import calendar as months
import datetime as dt
import re

from measureloom.contract import COMPARISON_GRANULARITY, COMPARISONS, TIME_COMPARISONS
from measureloom.functions import calendar as cal

Day = dt.date
Period = tuple[Day, Day, str, str]  # start, end, granularity, label


def month_start(year: int, month: int) -> Day | None:
    return dt.date(year, month, 1) if 1 <= month <= 12 and year >= 1 else None


def month_end(day: Day) -> Day:
    return day.replace(day=months.monthrange(day.year, day.month)[1])


def add_months(day: Day, n: int) -> Day:
    """The same day of another month, or its last day where that is earlier."""
    at = day.year * 12 + day.month - 1 + n
    first = dt.date(at // 12, at % 12 + 1, 1)
    return first.replace(day=min(day.day, month_end(first).day))


def days_after(day: Day, n: int) -> Day:
    return day + dt.timedelta(days=n)


def strict_day(text: str | None, form: str = r"\d{4}-\d{2}-\d{2}") -> Day | None:
    if not text or not re.fullmatch(form, text, re.ASCII):
        return None
    try:
        return dt.date(*map(int, text.split("-")))
    except ValueError:
        return None


def canonical(label: str) -> str:
    text = re.sub(r"\s+", "", label, flags=re.ASCII).upper().translate(str.maketrans(*cal._NUMBER_WORDS))
    for pattern, plain in cal._SPELLINGS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", plain), text, flags=re.ASCII)
    return text


def period(label: str) -> Period | None:
    """Start, end, granularity and normal label of a period; None if unreadable."""
    text = canonical(label)
    if span := re.match(cal._RANGE, text, re.ASCII):
        start, end = (strict_day(x, r"\d{4}-\d{1,2}-\d{1,2}") for x in span.groups())
        return _valid(start, end, "custom", f"{start}..{end}")
    found = re.match(cal._CANONICAL, text, re.ASCII)
    if not found:
        return None
    year, mark = int(found[1]), found[3] or ""
    month, n = (int(x) if x else None for x in (found[2], found[4]))
    if mark in ("Q", "H"):
        size = 3 if mark == "Q" else 6
        start = month_start(year, n * size - size + 1)
        return start and _valid(start, month_end(add_months(start, size - 1)),
                                "quarter" if mark == "Q" else "half", f"{year:04d}{mark}{n}")
    if mark == "W":
        try:
            start = dt.date.fromisocalendar(year, n, 1) if month is None else None
        except ValueError:
            start = None
        return start and _valid(start, days_after(start, 6), "week", f"{year:04d}-W{n:02d}")
    if mark == "X":
        start = month_start(year, month) if month is not None else None
        start = start and days_after(start, (n - 1) * 10)
        return start and _valid(start, days_after(start, 9) if n < 3 else month_end(start), "xun",
                                f"{start:%Y-%m}-X{n}")
    start = month_start(year, 1 if month is None else month)
    if start is None:
        return None
    if month is None:
        return _valid(start, dt.date(year, 12, 31), "year", f"{year:04d}")
    return _valid(start, month_end(start), "month", f"{start:%Y-%m}")


def _valid(start: Day | None, end: Day | None, kind: str, label: str) -> Period | None:
    return (start, end, kind, label) if start and end and start <= end else None


def baseline(comparison: str, start: Day, end: Day, granularity: str,
             custom: Period | None = None) -> tuple[Day, Day] | None:
    """Start and end of the baseline of a comparison; None when there is none."""
    kind = COMPARISONS[comparison]
    if kind not in TIME_COMPARISONS or COMPARISON_GRANULARITY.get(comparison, granularity) != granularity:
        return None
    before = days_after(start, -1)
    if kind == "year_over_year":
        return add_months(start, -12), add_months(end, -12)
    if kind == "custom":
        return custom and custom[:2]
    if kind not in ("period_over_period", "previous_equal_window"):
        if granularity == "month":
            return before.replace(day=1), before
        if granularity == "week":
            return days_after(start, -7), before
        if granularity == "quarter":
            return before.replace(month=(before.month - 1) // 3 * 3 + 1, day=1), before
        if granularity == "half":
            return before.replace(month=1 if before.month <= 6 else 7, day=1), before
        if granularity == "year":
            return dt.date(start.year - 1, 1, 1), dt.date(start.year - 1, 12, 31)
    return days_after(start, -((end - start).days + 1)), before
