"""Read times written in any common form, by the kind and order of their fields.

No list of formats is tried. The clock is taken out of a text, then a month's name; what is left are
numbers, and how many they are, how long and how large says which is the year, the month and the day.
The cost of a cell does not depend on how many forms a column mixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of months, words that may stand in a date, and the order month, day, year where
# numbers allow more than one reading.
_MONTH = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
          "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAY = "mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs?|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
_WORDS = f"(?<![a-z])(?:{_WEEKDAY}|at|on|of|and|st|nd|rd|th|t)(?![a-z])"
_NAMED = f"(?<![a-z])({_MONTH})(?![a-z])"
_CLOCK = r"(?<!\d)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,9}))?)?(?!\d)(?:\s*([ap])\.?m\b\.?)?"
_HOUR = r"(?<!\d)(\d{1,2})\s*([ap])\.?m\b\.?"
_OFFSET = r"(?<=\d)\s*(z|[+-]\d{2}:?\d{2})\z"
_BETWEEN = r"[\s,;/.'\-年月日号]|\d"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?\z"
_PACKED = r"^\d{12}(\d{2})?\z"
#: Two-digit years lie less than this many years ahead, and otherwise in the past.
_AHEAD = 50


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _full_year(c: Column, digits: Column) -> Column:
    """A year of one or two digits is moved to the hundred years around today."""
    now = F.year(F.current_date())
    near = c + (now - now % 100)
    near = F.when(near >= now + _AHEAD, near - 100).when(near < now - _AHEAD, near + 100).otherwise(near)
    return F.when(digits <= 2, near).otherwise(c)


def _let(value: Column, body) -> Column:
    """What ``body`` makes of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wall_clock(text: Column) -> Column:
    """A text without offset as a timestamp without zone; null where it is no time.

    Numbers: year, month, day if the first has more than two digits or exceeds 31; else day, month,
    year if the first exceeds 12; else month, day, year. With a month's name the first number is the
    day, unless only the other can be. A year and a month give the first day, a year alone its first
    day, eight digits year, month and day, twelve or fourteen also the time. Quarters give their first day.
    """
    iso = F.regexp_replace(text, "T", " ").try_cast("timestamp_ntz")
    return F.when(text.rlike(_ISO), iso).otherwise(_let(F.lower(text), _quarter_or_date))


def _quarter_or_date(low: Column) -> Column:
    quarter = r"^(?:(\d{4})[\s\-]?q([1-4])|q([1-4])[\s\-]?(\d{4}))\z"
    of = lambda a, b: _number(F.concat(F.regexp_extract(low, quarter, a), F.regexp_extract(low, quarter, b)))
    zero = F.lit(0)
    first = F.try_make_timestamp_ntz(of(1, 4), of(2, 3) * 3 - 2, F.lit(1), zero, zero, F.lit(0).cast("decimal(16,6)"))
    kinds = F.struct(low.alias("low"), low.rlike(_CLOCK).alias("clocked"), low.rlike(_HOUR).alias("houred"),
                     low.rlike(_PACKED).alias("packed"))
    return F.when(low.rlike(quarter), first).otherwise(_let(kinds, _clock_and_date))


def _clock_and_date(s: Column) -> Column:
    """Take out the clock; go on with the date."""
    low, clocked, houred, packed = s["low"], s["clocked"], s["houred"], s["packed"]
    part = lambda k: _number(F.regexp_extract(low, _CLOCK, k))
    cut = lambda at: _number(F.substring(low, at, 2))
    half = F.when(clocked, F.regexp_extract(low, _CLOCK, 5)).when(houred, F.regexp_extract(low, _HOUR, 2)).otherwise("")
    hour = F.when(clocked, part(1)).when(houred, _number(F.regexp_extract(low, _HOUR, 1))).when(packed, cut(9)).otherwise(0)
    minute = F.when(clocked, part(2)).when(packed, cut(11)).otherwise(0)
    second = F.when(clocked, F.coalesce(part(3), F.lit(0))).when(packed, F.coalesce(cut(13), F.lit(0))).otherwise(0)
    fraction = F.concat(F.lit("0."), F.when(clocked, F.regexp_extract(low, _CLOCK, 4)).otherwise(""), F.lit("0"))
    date = F.when(clocked, F.regexp_replace(low, _CLOCK, " ")).when(houred, F.regexp_replace(low, _HOUR, " ")).when(
        packed, F.substring(low, 1, 8)).otherwise(low)
    found = F.struct(half.alias("half"), hour.alias("hour"), minute.alias("minute"), second.alias("second"),
                     fraction.try_cast("decimal(16,6)").alias("fraction"), date.alias("date"),
                     F.regexp_extract(date, _NAMED, 1).alias("name"), F.regexp_extract_all(date, F.lit(r"\d+"), F.lit(0)).alias("runs"))
    return _let(found, _assembled)


def _assembled(s: Column) -> Column:
    """A timestamp from the clock, the month's name and the numbers of the date."""
    date, name, runs, count = s["date"], s["name"], s["runs"], F.size(s["runs"])
    bare = F.regexp_replace(F.regexp_replace(date, _NAMED, " "), r"(?<=\d)(st|nd|rd|th)(?![a-z])|" + _WORDS, " ")
    clean = F.regexp_replace(bare, _BETWEEN, "") == ""
    run = [F.get(runs, F.lit(k)) for k in range(3)]
    value, length = [_number(r) for r in run], [F.length(r) for r in run]
    month = ((F.position(F.substring(name, 1, 3), F.lit(_STARTS)) + 2) / 3).cast("int")
    year_first = (length[0] > 2) | (value[0] > 31)

    def ymd(y: int, m: Column, d: int | None) -> Column:
        return F.struct(_full_year(value[y], length[y]).alias("y"), m.alias("m"),
                        (F.lit(1) if d is None else value[d]).alias("d"))

    # A date of two numbers is written with a dash, a slash or a word, not as a decimal number.
    pair = ~date.rlike(r"^\s*\d+\.\d+\s*\z")
    packed_day = F.struct(*[_number(F.substring(run[0], at, n)).alias(k) for k, at, n in (("y", 1, 4), ("m", 5, 2), ("d", 7, 2))])
    fields = (F.when((name != "") & (count == 2), F.when(year_first, ymd(0, month, 1)).otherwise(ymd(1, month, 0)))
              .when((name != "") & (count == 1) & (length[0] == 4), ymd(0, month, None))
              .when(name != "", None)
              .when((count == 3) & year_first, ymd(0, value[1], 2))
              .when((count == 3) & (value[0] > 12), ymd(2, value[1], 0))
              .when(count == 3, ymd(2, value[0], 1))
              .when((count == 2) & pair & (length[0] == 4), ymd(0, value[1], None))
              .when((count == 2) & pair & (length[1] == 4), ymd(1, value[0], None))
              .when((count == 1) & (length[0] == 8), packed_day)
              .when((count == 1) & (length[0] == 4), ymd(0, F.lit(1), None)))
    hour = F.when(s["half"] == "", s["hour"]).when(
        (s["hour"] >= 1) & (s["hour"] <= 12), s["hour"] % 12 + F.when(s["half"] == "p", 12).otherwise(0))
    return F.when(clean, _let(fields, lambda f: F.try_make_timestamp_ntz(
        f["y"], f["m"], f["d"], hour, s["minute"], s["second"].cast("decimal(16,6)") + s["fraction"])))


def moment(text: Column, timezone: str | None = None) -> Column:
    """A text as business wall-clock time: one with an offset is moved to ``timezone`` (UTC if none)."""
    return _let(text, lambda t: _moved(t, timezone))


def _moved(text: Column, timezone: str | None) -> Column:
    low = F.lower(text)
    zoned = low.rlike(_OFFSET) & low.contains(":")
    sign = F.regexp_extract(low, _OFFSET, 1)
    digits = F.regexp_replace(sign, "[^0-9]", "")
    minutes = _number(F.substring(digits, 1, 2)) * 60 + _number(F.substring(digits, 3, 2))
    minutes = F.when(sign == "z", 0).when(F.substring(sign, 1, 1) == "-", -minutes).otherwise(minutes)
    body = F.when(zoned, F.regexp_replace(text, "(?i)" + _OFFSET, "")).otherwise(text)
    local = wall_clock(body)
    utc = local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    moved = F.convert_timezone(F.lit("UTC"), F.lit(timezone or "UTC"), utc)
    return F.when(zoned, moved).otherwise(local).cast("timestamp")


def forms(df: DataFrame, name: str) -> DataFrame:
    """The forms of a text column and how many cells have and do not have a readable time of it.

    Columns: form (digits as 9, letters as a), rows, unread. One row per form, most cells first is up
    to the caller.
    """
    text = F.trim(F.col(f"`{name}`").cast("string"))
    form = F.regexp_replace(F.regexp_replace(text, r"\p{L}", "a"), r"\d", "9")
    return df.where(F.col(f"`{name}`").isNotNull()).select(form.alias("form"), moment(text).isNull().alias("_u")).groupBy(
        "form").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_u").alias("unread"))
