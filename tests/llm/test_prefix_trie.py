"""The trie against plain code on conversations of very unequal length."""

import hashlib
import random
import zlib
from collections import defaultdict

from measureloom.llm import prefix_trie, ranks
from measureloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def expected(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[d, tuple(turns[:d])].append(c)
    out = {}
    for (d, prefix), cs in members.items():
        below = [(e, p, m) for (e, p), m in members.items() if e >= d and p[:d] == prefix]
        kids = [p for (e, p) in members if e == d + 1 and p[:d] == prefix]
        leaves = sum(not any(q[:e] == p for (f, q) in members if f == e + 1) for e, p, _ in below)
        saved = sum((len(m) - 1) * len(p[-1][1]) for e, p, m in below if e)
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == d)))
        parent = min(members[d - 1, prefix[:-1]]) if d else None
        out[d, min(cs)] = (parent, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    got = QUERIES["op12_prefix_trie"](spark, str(folder)).collect()
    nodes = {(r["depth"], r["conv_id"]): tuple(r)[2:] for r in got}
    assert len(nodes) == len(got)
    return nodes


def cases(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(95, 130), 200, 201, 205, 1000, 7, 12, 305]:
        n = rng.choice([1, 2, 3, 4, 6, 9, 17, 33])
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), rng.choice(["a", "é", None])) for t in range(n)]
    rows += [(205, 50, "user", "same")] * 9  # equal rows
    return [*rows, (None, 0, "user", "lost")]


def test_against_plain_code(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    monkeypatch.setattr(ranks, "REPEATS", 4)
    rows = cases(1)
    assert found(spark, tmp_path, rows) == expected(rows)


def test_few_rows(spark, tmp_path):
    assert found(spark, tmp_path / "a", []) == {}
    one = [(3, 0, "user", "x")]
    assert found(spark, tmp_path / "b", one) == expected(one)  # h is 5, the lead absent: no turn is left
    both = [(0, None, None, None), (3, 0, "user", "x")]
    assert found(spark, tmp_path / "c", both) == expected(both)


def test_joined_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "small_enough", lambda keys: keys)
    rows = cases(3)
    assert found(spark, tmp_path, rows) == expected(rows)


def test_other_columns(spark):
    df = spark.createDataFrame([("4", 1, "user", "a", 5, 6)], "id string, n long, who string, body string, conv int, n1 int")
    rows = prefix_trie.turns(df, "id", "n", "who", "body")
    nodes, ends = prefix_trie.build(rows, df.selectExpr("cast(id as long) conv"))
    assert sorted((r["depth"], r["conv_id"], r["n_convs"], r["n_leaves"]) for r in nodes.collect()) == [(0, 4, 1, 1), (1, 4, 1, 1)]
    assert ends.count() == 1
