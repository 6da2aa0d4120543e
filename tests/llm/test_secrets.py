"""Secret spans against plain code."""

import math
import random
import re
import string

from measureloom.llm import secrets as sc


def base(text):
    found = []
    for kind, pattern, least, group, flags in (
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.I | re.A),
            ("access", r"AKIA[A-Z0-9]+", 20, 0, 0), ("hex", r"[0-9a-f]+", 24, 0, 0)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def sample(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(30):
        k = rng.randrange(9)
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([10, 23, 24, 40])))
        key = "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(rng.choice([15, 16, 20])))
        word = rng.choice(["PassWord", "passwd", "secret", "Token", "api_key", "APIKEY", "toKen"])
        parts.append([f"{word}={hexa[:7]}", f"{word}\"  :  '{key}", f"AKIA{key}", hexa, "größe", f"{word} = a.b",
                      "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(44)),
                      "x" * 30, f"é{hexa}é"][k])
    return rng.choice([" ", "\n", ""]).join(parts)


def test_base_spans_are_those_of_the_patterns():
    for seed in range(300):
        text = sample(seed)
        assert [s for s in sc.find(text) if s[1] != "entropy"] == base(text)


def test_incremental_entropy_equals_direct_entropy():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("abcdefghij0123456789XYZ") for _ in range(rng.randrange(18, 80)))
        direct = []
        for i in range(len(text) - sc.WINDOW + 1):
            w = text[i:i + sc.WINDOW]
            h = -sum(w.count(c) / sc.WINDOW * math.log2(w.count(c) / sc.WINDOW) for c in set(w))
            if h >= 3.5 + 1e-9:
                direct.append((i, i + sc.WINDOW))
        merged = []
        for a, b in direct:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        assert sc.entropy_spans(text, 3.5 + 1e-9) == merged


def test_entropy_adds_and_the_allow_list_takes_away():
    blob = "q7Xv9LmZ2pKfT4wRb8NcYd3HsJg6"
    assert [s[1] for s in sc.find(f"see {blob} there")] == ["entropy"]
    for harmless in ("123e4567-e89b-12d3-a456-426614174000", "ein-sehr-langer-name-2024-05-17", "Donaudampfschifffahrtsgesellschaft",
                     "12345678901234567890123", "--------------------------", f"sha256: {blob}"):
        assert not [s for s in sc.find(harmless) if s[1] == "entropy"], harmless


def test_rows_and_masks(docs):
    texts = [None, "", "clean", "a token=abcdef1 b", "x" * 200_000 + " AKIA" + "A1B2" * 4, "token=abcdef1"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in sc.scan(docs(texts)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [("assign", 2, 15)], 4: [("access", 200_001, 200_021)], 5: [("assign", 0, 13)]}
    out = sc.redact(docs(texts), length_col="n_chars")
    assert out.columns == docs(texts).columns
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert rows[3] == ("a [SECRET] b", 12) and rows[0] == (None, None) and rows[2] == ("clean", 5)


def test_empty_and_clashing(spark, docs):
    assert sc.scan(docs([])).count() == 0
    df = spark.createDataFrame([(None, "token=abcdef1", 5, 6)], "doc_id bigint, text string, spans int, id int")
    assert [(r[0], len(r[1])) for r in sc.scan(df).collect()] == [(None, 1)]
