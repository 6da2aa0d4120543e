"""Cheapest repair of the role structure of conversations, by an automaton that shares suffixes.

Each conversation is written as a signature, one letter a row for its role and fault. Equal signatures
are one; sorted from their ends, those with a common suffix follow each other, so that a node of the
minimal acyclic automaton, which stands for one remaining signature, is built once, by whoever of its
conversations comes first. A node holds, for each state of the grammar, the cheapest cost from there
to the end and the first edit of the best audit; the rest of that audit is the node it leads to. The
edits with equal costs differ in their first letter, so the least letter gives the least audit.

The grammar (s?(ua)+)? has four states: nothing yet, after s, after u, after a. Every state expects one
role of u and a, which is the one that edits insert or assign.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reliable, small

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_NEVER = 1 << 60
_STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)
_EXPECTED = ("user", "user", "assistant", "user")
_BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of signatures and audits that may be broadcast.
BROADCAST_BYTES = 32 << 20


class Suffixes:
    """Nodes from the end to the start of the last signature; a node stands for one suffix.

    Nodes are kept in flat arrays, 36 bytes each, and only those of the current signature.
    """

    def __init__(self):
        self.signature = ""  # reversed
        self.cost = array("q")
        self.edit = bytearray()
        self.built = 0
        self._push([(0, ""), (_NEVER, ""), (_NEVER, ""), (0, "")])

    def _push(self, best: list[tuple[int, str]]) -> None:
        start, after_s, after_u, after_a = best
        after_u, after_a = (min(after_u, (after_a[0] + INSERT, "I")), min(after_a, (after_u[0] + INSERT, "I")))
        start = min(start, (after_u[0] + INSERT, "I"))
        after_s = min(after_s, (after_u[0] + INSERT, "I"))
        for cost, edit in (start, after_s, after_u, after_a):
            self.cost.append(cost)
            self.edit.append(ord(edit) if edit else 0)
        self.built += 1

    def _add(self, letter: str) -> None:
        rest = self.cost[-4:]
        role, late = letter.lower(), TRUNCATED if letter.isupper() else 0
        best = []
        for state in range(4):
            ways = [(rest[state] + DELETE, "D")]
            if letter != "x":
                ways.append((rest[_NEXT[state]] + REROLE + late, "R"))
                if role in _STEP[state]:
                    ways.append((rest[_STEP[state][role]] + KEEP + late, "K"))
            best.append(min(ways))
        self._push(best)

    def audit(self, reversed_signature: str) -> tuple[int, str]:
        """Cost and best audit of a signature, given from its end."""
        old, same = self.signature, 0
        for a, b in zip(old, reversed_signature, strict=False):
            if a != b:
                break
            same += 1
        del self.cost[4 * (same + 1):], self.edit[4 * (same + 1):]
        for letter in reversed_signature[same:]:
            self._add(letter)
        self.signature = reversed_signature
        at, state, out = len(reversed_signature), 0, []
        while edit := self.edit[4 * at + state]:
            out.append(edit)
            if edit == ord("I"):
                state = _NEXT[state]
                continue
            at -= 1
            if edit == ord("K"):
                state = _STEP[state][reversed_signature[at].lower()]
            elif edit == ord("R"):
                state = _NEXT[state]
        return self.cost[4 * len(reversed_signature)], bytes(out).decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with damage by crc32(`conv_id:turn`) % 20; nulls of the texts and the key count as a blank.

    0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it the user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("_kind"), name("role").alias("role"), name("text").alias("text"))
    rows = rows.where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return rows.drop("_copy")


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _plain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(role_col, F.lit(" ")), F.coalesce(text_col, F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
                       text.alias("text"), _digest(role, text).alias("d"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order: signature, gaps and faults."""
    names = ("conv", "signature", "gaps", "blank", "duplicate", "truncated", "illegal")
    held, out, types = None, {k: [] for k in names}, None

    def done():
        conv, letters, low, high, turns, _, blank, duplicate, truncated, illegal, _ = held
        gaps = 0 if low is None else high - low + 1 - turns
        for k, v in zip(names, (conv, "".join(letters), gaps, blank, duplicate, truncated, illegal), strict=True):
            out[k].append(v)

    def flushed():
        columns = [pa.array(out[k], t) for k, t in zip(names, types, strict=True)]
        for k in names:
            out[k].clear()
        return pa.RecordBatch.from_arrays(columns, names=list(names))

    for batch in batches:
        types = types or [batch.schema.field("conv").type, pa.string(), *[pa.int64()] * 5]
        columns = (batch.column(k).to_pylist() for k in ("conv", "turn", "role", "fault", "first", "times"))
        for conv, turn, role, fault, first, times in zip(*columns, strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    done()
                held = [conv, [], None, None, 0, None, 0, 0, 0, 0, None]
            if turn is not None and turn != held[5]:
                held[2] = turn if held[2] is None else held[2]
                held[3], held[5] = turn, turn
                held[4] += 1
            sound = 0
            if fault == "blank":
                held[6] += times
            else:
                sound = 1 if first else 0
                held[7] += times - sound
                held[8] += sound if fault == "truncated" else 0
            held[1].append((role.upper() if fault == "truncated" else role) * sound + "x" * (times - sound))
            if held[10] is not None and held[10] + role not in ("su", "ua", "au"):
                held[9] += 1
            held[9] += times - 1
            held[10] = role
        if len(out["conv"]) >= 1000:
            yield flushed()
    if held is not None:
        done()
        yield flushed()


def signatures(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Per conversation (conv) its signature and faults: gaps, blank, duplicate, truncated, illegal.

    Letters: s, u, a or o (any other role, an empty one included), as capitals where the text is
    truncated, and x where a row has to go (blank or repeated). Null roles and texts are one blank; a
    null conversation is one of its own. Rows are taken by turn, null turns first, those of equal turn
    by digest of role and text. Equal rows are counted first; texts are not shuffled here. Rows of one
    conversation pass one task in order, of which a letter a row is held.
    """
    rows = _plain(rows, conv_col, turn_col, role_col, text_col)
    ending = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(ending == "", "blank").when(F.right(ending, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    initial = F.substring("role", 1, 1)
    once = rows.select("conv", "turn", "d", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"),
                       fault.alias("fault")).groupBy("conv", "turn", "d", "role", "fault").agg(
        F.count(F.lit(1)).alias("times"))
    once = reliable(once)
    earliest = once.groupBy("conv", "d").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))).alias("m")).select(
        F.col("conv").alias("_conv"), F.col("d").alias("_d"), F.col("m.turn").alias("_turn"))
    flagged = once.join(earliest, (F.col("d") == F.col("_d")) & F.col("conv").eqNullSafe(F.col("_conv"))
                        & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    lined = flagged.select("conv", "turn", "d", "role", "fault", F.col("_d").isNotNull().alias("first"), "times").repartition(
        "conv").sortWithinPartitions("conv", "turn", "d").drop("d")
    kind = rows.schema["conv"].dataType.simpleString()
    return lined.mapInArrow(_signed, f"conv {kind}, signature string, gaps long, blank long, duplicate long, "
                                     "truncated long, illegal long")


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared = Suffixes()
    for batch in batches:
        backwards = batch.column("backwards").to_pylist()
        found = [shared.audit(s) for s in backwards]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[::-1] for s in backwards], pa.string()), pa.array([c for c, _ in found], pa.int64()),
             pa.array([a for _, a in found], pa.string())], names=["_signature", "cost", "audit"])


def audits(found: DataFrame) -> DataFrame:
    """Cost and best audit of every distinct signature: _signature, cost, audit.

    Signatures are dealt out in ranges of their reversed letters, so that suffixes meet their like.
    """
    backwards = found.select(F.reverse("signature").alias("backwards")).distinct()
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(
        _audited, "_signature string, cost long, audit string")


def diagnose(rows: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """The signatures with cost and audit of the cheapest repair, one row per conversation (conv)."""
    found = reliable(signatures(rows, conv_col, **columns))
    priced = reliable(audits(found))
    held = priced.agg(F.sum(F.length("_signature") + F.length("audit"))).first()[0] or 0
    priced = F.broadcast(priced) if held <= BROADCAST_BYTES else priced
    return found.join(priced, F.col("signature") == F.col("_signature")).drop("_signature")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the repaired conversations: each conversation's audit comes before its rows."""
    conv, audit, at, state, place, kind = None, None, 0, 0, 0, None
    out = []

    def put(role, text, edit):
        nonlocal place
        out.append((conv, place, role, text, edit))
        place += 1

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            put(_EXPECTED[state], "", "I")
            at, state = at + 1, _NEXT[state]

    def flushed():
        columns = list(zip(*out, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()),
                                            *[pa.array(c, pa.string()) for c in columns[2:]]],
                                           names=["conv", "place", "role", "text", "edit"])
        out.clear()
        return batch

    for batch in small(batches):
        kind = kind or batch.schema.field("conv").type
        for c, is_row, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "is_row", "role", "text")), strict=True):
            if not is_row:
                if audit is not None:
                    inserts()
                conv, audit, at, state, place = c, text, 0, 0, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                put(role, text, "K")
                state = _STEP[state][role[0]]
            elif edit == "R":
                put(_EXPECTED[state], text, "R")
                state = _NEXT[state]
        if out:
            yield flushed()
    if audit is not None:
        inserts()
    if out:
        yield flushed()


def repair(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The repaired rows: conv, place (0 first), role, text and edit (K, R or I).

    `found` is what `diagnose` said of the same rows. Texts are shuffled once, to their conversation,
    and pass in order; those of a conversation stay together in the result.
    """
    rows = _plain(rows, conv_col, turn_col, role_col, text_col)
    heads = found.select("conv", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"),
                         F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("role"),
                         F.col("audit").alias("text"))
    lined = heads.unionByName(rows.withColumn("is_row", F.lit(True))).repartition("conv").sortWithinPartitions(
        "conv", "is_row", "turn", "d").select("conv", "is_row", "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()
    return lined.mapInArrow(_repaired, f"conv {kind}, place long, role string, text string, edit string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running, kind = None, None, None
    for batch in batches:
        kind = kind or batch.schema.field("conv").type
        done = []
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
            if running is not None and c == conv:
                running.update(b"\n")
            else:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = c, hashlib.sha256()
            running.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])],
                                             names=["conv", "sha"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([running.hexdigest()])], names=["conv", "sha"])


def fingerprints(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, `role:text` joined by line breaks: conv, sha.

    Takes the rows as `repair` leaves them; only the running hash of one conversation is held.
    """
    kind = repaired.schema["conv"].dataType.simpleString()
    return repaired.mapInArrow(_hashed, f"conv {kind}, sha string")
