"""Personal data replaced by pseudonyms of the same format.

Numbers and dates are validated first: card numbers and bank accounts by their check digits, addresses
by the range of their parts, dates by the calendar. Each valid value is permuted within all values of
its format by a keyed Feistel network, so that equal values get equal pseudonyms in every document,
different values different ones, and the pseudonym is valid again. Without the key a value cannot be
told from its pseudonym; with it the permutation can be undone.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

ROUNDS = 10
KINDS = ("email", "ip", "iban", "card", "phone", "ssn", "date")

PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![A-Za-z0-9-])"),
    "ip": re.compile(r"(?<![0-9.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9]|\.[0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|"
                       r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![A-Za-z0-9])"),
    "phone": re.compile(r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|"
                        r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])"),
    "date": re.compile(r"(?<![0-9./-])(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})|"
                       r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}))(?![0-9]|[./-][0-9])"),
}
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1


def _round(key: bytes, tweak: str, step: int, half: int, modulus: int) -> int:
    data = f"{tweak}|{step}|{half}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big") % modulus


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over two factors, walked until inside."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if step % 2 == 0:
                move = _round(key, tweak, step, right, a)
                left = (left - move if back else left + move) % a
            else:
                move = _round(key, tweak, step, left, b)
                right = (right - move if back else right + move) % b
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit for digits that lack theirs."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _digits(text: str, key: bytes, tweak: str, back: bool) -> str:
    return str(permute(int(text), 10 ** len(text), key, f"{tweak}{len(text)}", back)).zfill(len(text)) if text else text


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits permuted within their class at every place, other characters kept."""
    bases = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower()
              else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isalnum() else None for c in text]
    value, size = 0, 1
    for c, base in zip(text, bases, strict=True):
        if base:
            value, size = value * len(base) + base.index(c), size * len(base)
    shape = "".join(c if base is None else base[0] for c, base in zip(text, bases, strict=True))
    value = permute(value, size, key, f"{tweak}{shape}", back)
    out = []
    for c, base in zip(reversed(text), reversed(bases), strict=True):
        if base:
            value, k = divmod(value, len(base))
            c = base[k]
        out.append(c)
    return "".join(reversed(out))


def pseudonym(kind: str, m: re.Match, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a match, or None where it is not a valid value of its kind."""
    text = m[0]
    digits = "".join(c for c in text if c.isdigit())
    if kind == "email":
        return f"{_mixed(m[1], key, 'email', back)}@{m[2]}" if m[1][0] != "." and ".." not in text else None
    if kind == "ip":
        parts = [int(x) for x in m.groups()]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.groups()):
            return None
        value = permute(int.from_bytes(bytes(parts), "big"), 2 ** 32, key, "ip", back)
        return ".".join(str(x) for x in value.to_bytes(4, "big"))
    if kind == "iban":
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = _mixed(plain[4:], key, "iban", back)
        new = iter(f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)
    if kind == "card":
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        head = digits[0] + _digits(digits[1:-1], key, "card", back)
        return _refill(text, head + str(luhn(head)))
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        code = re.match(r"\+[0-9]{1,3}(?![0-9])", text)
        fixed = len(code[0]) - 1 if code else 0
        return _refill(text, digits[:fixed] + _digits(digits[fixed:], key, "phone", back))
    if kind == "ssn":
        area, group, serial = (int(x) for x in m.groups())
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        # Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999, as one number.
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(permute(value, 898 * 99 * 9999, key, "ssn", back), 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
    return _date(m, key, back)


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    """Dates are permuted as days; the order of day and month follows the separator, where both fit."""
    y, mo, d, a1, b1, y1, a2, b2, y2 = m.groups()
    try:
        if y:
            order, day = "ymd", dt.date(int(y), int(mo), int(d))
        elif y1:  # month first, unless only day first is a date
            order = "mdy" if int(a1) <= 12 else "dmy"
            day = dt.date(int(y1), *((int(a1), int(b1)) if order == "mdy" else (int(b1), int(a1))))
        else:
            order, day = "d.m.y", dt.date(int(y2), int(b2), int(a2))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    value, tweak = (day - FIRST_DAY).days, "date"
    if order == "dmy":  # stays among dates that can only be read day first
        days = [k for k in range(13, 32)]
        slots = 200 * 12 * len(days)
        while True:
            at = permute(((day.year - 1900) * 12 + day.month - 1) * len(days) + day.day - 13, slots, key, "dmy", back)
            rest, k = divmod(at, len(days))
            year, month = divmod(rest, 12)
            try:
                day = dt.date(1900 + year, month + 1, days[k])
                return f"{day.day:02d}/{day.month:02d}/{day.year}"
            except ValueError:  # not a day of its month: walk on
                day = _Slot(1900 + year, month + 1, days[k])
    day = FIRST_DAY + dt.timedelta(days=permute(value, DAYS, key, tweak, back))
    if order == "ymd":
        return day.isoformat()
    return f"{day.month:02d}/{day.day:02d}/{day.year}" if order == "mdy" else f"{day.day:02d}.{day.month:02d}.{day.year}"


class _Slot:
    """A place of the day-first permutation that is no calendar day."""

    def __init__(self, year: int, month: int, day: int):
        self.year, self.month, self.day = year, month, day


def find(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values, in order; earlier kinds win where two overlap."""
    if "@" not in text and not any(c in text for c in "0123456789"):
        return []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            start, end = m.span()
            if taken and any(a < end and start < b for a, b in taken):
                continue
            new = pseudonym(kind, m, key, back)
            if new is not None:
                found.append((start, end, kind, new))
                taken.append((start, end))
    return sorted(found)


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text",
                 back: bool = False) -> DataFrame:
    """One row per document row: the id, the text with pseudonyms, and spans of what was replaced.

    ``spans`` holds kind, start and end in the given text, and the pseudonym, in order. ``back`` undoes
    the permutation, for the holder of the key. Null texts stay null and hold nothing; ids may be null
    or repeat; whole texts are read; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            found = [find(t, key, back) if t else [] for t in texts]
            new = [replaced(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            spans = [[{"kind": k, "start": a, "end": b, "pseudonym": p} for a, b, k, p in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new, pa.string()), pa.array(spans, pa.list_(span))], ["id", "text", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, text string, spans array<struct<kind:string,start:bigint,end:bigint,pseudonym:string>>"
    ).withColumnRenamed("id", id_col)
