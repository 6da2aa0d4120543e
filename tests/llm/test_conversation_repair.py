"""Repairs against a search over all edits, and the whole query against plain code."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from measureloom.llm import conversation_repair as cr
from measureloom.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


@cache
def cheapest(signature):
    """Cost, audit and roles of the best repair: every edit string of the rows and up to `limit` inserts.

    Roles are free here, not tied to a state of the grammar.
    """
    best = None
    n = len(signature)
    for inserts in range(n + 3):
        if best and 5 * inserts > best[0]:
            break
        for places in itertools.combinations_with_replacement(range(n + 1), inserts):
            for edits in itertools.product(*["D" if x == "x" else "DKR" for x in signature]):
                cost = 5 * inserts + sum({"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and x.isupper() else 0)
                                         for e, x in zip(edits, signature, strict=True))
                if best and cost > best[0]:
                    continue
                steps = []
                for i in range(n + 1):
                    steps += ["I"] * places.count(i)
                    if i < n:
                        steps.append(edits[i] + signature[i].lower())
                audit = "".join(s[0] for s in steps)
                if best and (cost, audit) >= best[:2]:
                    continue
                free = [s[1] if s[0] == "K" else "?" for s in steps if s[0] != "D"]
                for roles in itertools.product(*["ua" if r == "?" else r for r in free]):
                    if LEGAL.fullmatch("".join(roles)):
                        best = (cost, audit, "".join(roles))
                        break
    return best


def faults(rows):
    """Signature, counts and repaired rows of one conversation's rows in order, by plain code."""
    letters, seen, count = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        if fault:
            count[fault] += 1
        letter = role[0] if role[:1] in ("s", "u", "a") and role else "o"
        letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return letters, gaps, count, illegal


def expected(rows):
    """The query's columns for each conversation of (conv_id, turn, role, text)."""
    out, kept = {}, {}
    for c, t, r, x in rows:
        kept.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 1:
            x = ""
        if kind == 2:
            x = re.sub(r"[.!?]", "", x)
        if kind == 4:
            r = "user"
        kept[c] += [(t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    digest = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    for c, mine in kept.items():
        mine.sort(key=lambda v: (v[0] is not None, v[0] or 0, digest(v[1], v[2])))
        letters, gaps, count, illegal = faults(mine)
        cost, audit, roles = cheapest(letters)
        repaired, at, k = [], 0, 0
        for e in audit:
            if e != "D":
                name = {"u": "user", "a": "assistant", "s": "s"}[roles[k]]
                k += 1
                repaired.append(f"{name}:" if e == "I" else f"{mine[at][1] if e == 'K' else name}:{mine[at][2]}")
            at += e != "I"
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                  hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def test_every_short_signature():
    """Short signatures, in the order of their ends and in any other."""
    words = ["".join(w) for n in range(4) for w in itertools.product("suaoSUAOx", repeat=n)]
    words += ["".join(random.Random(k).choice("suaoSUAx") for _ in range(4)) for k in range(150)]
    shared = cr.Suffixes()
    for w in sorted(words, key=lambda w: w[::-1]):
        assert shared.audit(w[::-1]) == cheapest(w)[:2], w
    random.Random(1).shuffle(words)
    for w in words[:200]:
        assert shared.audit(w[::-1]) == cheapest(w)[:2], w


def test_a_node_is_built_once():
    words = sorted({"".join(random.Random(k).choice("suax") for _ in range(8)) for k in range(300)}, key=lambda w: w[::-1])
    shared = cr.Suffixes()
    for w in words:
        shared.audit(w[::-1])
    assert shared.built == len({w[k:] for w in words for k in range(len(w) + 1)})


def test_long_conversations():
    shared = cr.Suffixes()
    assert shared.audit("au" * 50_000) == (0, "K" * 100_000)
    assert shared.audit("x" * 100_000) == (200_000, "D" * 100_000)


def cases(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", None, "Hm. \t", "É!", "a b"]
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 5)):
            rows.append((c, rng.choice([None, t, t, t + 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    return [*rows, rows[0], rows[0]]


def table(spark, tmp_path, rows, name="conversations"):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", [5, 6])
def test_query_against_plain_code(spark, tmp_path, seed):
    rows = cases(seed)
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, table(spark, tmp_path, rows)).collect()}
    assert got == expected(rows)


def test_query_on_the_supplied_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = {c for c in {r[0] for r in rows} if sum(r[0] == c for r in rows) <= 5}
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    want = expected([r for r in rows if r[0] in short])
    assert {c: got[c] for c in short} == want


def test_no_rows_and_dropped_conversations(spark, tmp_path):
    assert QUERIES["op11_conversation_repair"](spark, table(spark, tmp_path, [])).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    other = tmp_path / "b"
    got = QUERIES["op11_conversation_repair"](spark, table(spark, other, [(gone, 0, "user", "A.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_and_clashing_names(spark):
    data = [("c", 1, "user", "Hello.", 9, "x"), ("c", 2, "user", "Well", 9, "x"), ("c", 3, "assistant", "Good.", 9, "x")]
    df = spark.createDataFrame(data, "conv_id string, turn long, role string, text string, conv int, d string")
    found = cr.diagnose(df)
    assert [(r["signature"], r["cost"], r["audit"]) for r in found.collect()] == [("uUa", 2, "KDK")]
    got = cr.repair(df, found).orderBy("place").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in got] == [("user", "Hello.", "K"), ("assistant", "Good.", "K")]
