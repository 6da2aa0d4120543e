"""Secret scans: fixed patterns, and Shannon entropy in a sliding window over candidate strings.

Candidates are the longest runs of token characters. Each is put into a class by the characters it
holds; a window slides over it while counts of its characters are kept up to date one step at a time,
so that the entropy costs the same per character whatever the window. Windows at or above the
threshold of their class are joined into spans, unless an allow-list knows the string as harmless.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import light_batches, small

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LENGTH = 24
KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: The shortest candidate, and the window that slides over it.
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits per character from which a window of its class is suspicious (a window of 20 reaches 4.32).
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "mixed": 3.9}
#: Strings that are harmless however random they look.
ALLOWED = (
    re.compile(r"[A-Za-z_=-]*"),                                                    # words, rules
    re.compile(r"[0-9+/_=-]*"),                                                     # numbers
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"/?(?:[A-Za-z][a-z]*|[0-9]{1,4})(?:[/_=-](?:[A-Za-z][a-z]*|[0-9]{1,4}))*/?"),    # paths, slugs
)
#: Words before a string that name a digest of public content.
ALLOWED_BEFORE = re.compile(r"(?:commit|sha1|sha256|sha512|md5|etag|checksum|integrity)[\s:=\"'-]*$", re.IGNORECASE)

_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_ALNUM = re.compile(r"[A-Za-z0-9]+")
_LOGS = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def character_class(text: str) -> str:
    return "hex" if _HEX_ONLY.fullmatch(text) else "alnum" if _ALNUM.fullmatch(text) else "mixed"


def entropy_spans(text: str, threshold: float) -> list[tuple[int, int]]:
    """Joined windows of ``text`` whose entropy reaches the threshold; counts change by one step a time."""
    counts: dict[str, int] = {}
    total, spans, full = 0.0, [], math.log2(WINDOW)
    for i, c in enumerate(text):
        if i >= WINDOW:
            gone = text[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total += _LOGS[n - 1] - _LOGS[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _LOGS[n + 1] - _LOGS[n]
        if i >= WINDOW - 1 and full - total / WINDOW >= threshold:
            start = i - WINDOW + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span in order: base kinds, then entropy spans not inside one of them."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text)
                 if len(m[2]) >= ASSIGN_LENGTH]
    suspects = []
    for candidate in CANDIDATE.finditer(text):
        at, string = candidate.start(), candidate[0]
        # Base matches of these kinds never cross the edge of a candidate.
        found += [(at + m.start(), "access", at + m.end()) for m in ACCESS.finditer(string)
                  if len(m[0]) >= ACCESS_LENGTH]
        found += [(at + m.start(), "hex", at + m.end()) for m in HEX.finditer(string)
                  if len(m[0]) >= HEX_LENGTH]
        if any(p.fullmatch(string) for p in ALLOWED) or ALLOWED_BEFORE.search(text, max(0, at - 40), at):
            continue
        suspects += [(at + a, "entropy", at + b)
                     for a, b in entropy_spans(string, THRESHOLDS[character_class(string)])]
    found += [s for s in suspects if not any(f[0] <= s[0] and s[2] <= f[2] for f in found)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        spans = [[{"kind": k, "start": a, "end": b} for a, k, b in find(t)] if t else []
                 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: the id and all spans, in code points, end exclusive.

    Null and empty texts have no spans; whole texts are read whatever their length; ids may be null or
    repeat; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    light_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """The documents, all columns as they were, with every span of their text replaced by the mask.

    Overlapping spans are masked once. Rows without spans, null texts included, are untouched.
    ``length_col`` names a column that holds the text's code points, to be kept true.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in small(batches):
            texts = batch.column(at).to_pylist()
            new = [masked(t, mask) if t else t for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_col is not None:
                k = names.index(length_col)
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, new, strict=True)],
                                      batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    light_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def masked(text: str, mask: str = "[SECRET]") -> str:
    out, done = [], 0
    for start, _, end in find(text):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def joined(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"] != "entropy") if base_only else spans
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
