"""Scores against counts in plain code, and the tree against the axioms of probability."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from measureloom.llm import suffix_tree as st


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8)) % 900}" for _ in range(4000)]
    passage = "Once upon A time there was".split()
    texts = [None, "", " \n", "Solo"]
    for _ in range(n):
        body = rng.sample(words, rng.randrange(5, 60))
        if rng.random() < 0.6:
            body[rng.randrange(len(body)):0] = passage
        texts.append(" ".join(body + [f"unique{rng.random()}"]))
    return texts


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_base_scores_and_counts(docs):
    texts = corpus()
    tokens = [(t or "").lower().split() + ["</s>"] for t in texts]
    counts = Counter(w for i, t in enumerate(tokens) if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = st.score(docs(texts)).collect()
    assert len(rows) == len(texts)
    gain = 0.0
    for r in rows:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(w in counts for w in t)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0 and rows[0]["states"] > 0


def test_every_state_is_a_distribution():
    """Probabilities of all symbols, seen or left to the shorter state, add up to one in every state."""
    rng = random.Random(5)
    text = []
    for _ in range(3000):
        text += rng.choice([["a", "b", "c"], ["d", "b", "e"], ["a"], ["b"], ["f", "a", "b", "c"]])
    code = {w: k + 1 for k, w in enumerate(sorted(set(text)))}
    flat = np.array([code[w] for w in text], np.uint64)
    g = st.grams(flat, np.arange(len(flat)), st.DEPTH)
    seq = {c: [] for c in ("gram", "context", "shorter", "next", "size")}
    for size in range(1, st.DEPTH + 2):
        seen = {}
        for i in range(size - 1, len(flat)):
            seen[int(g[size - 1][i])] = i
        for x, i in seen.items():
            for c, y in (("gram", x), ("context", g[size - 2][i - 1] if size > 1 else 0),
                         ("shorter", g[size - 2][i] if size > 1 else 0), ("next", g[0][i]), ("size", size)):
                seq[c].append(int(y))
    seq = {c: np.array(v, np.int32 if c == "size" else np.uint64) for c, v in seq.items()}
    counts = Counter(int(x) for k in range(st.DEPTH + 1) for x in g[k][k:])
    unseen = 0.01
    tree = st.grow(seq, counts, len(flat), unseen)
    assert sum(len(c) for c in tree.contexts) > 3
    contexts = [st.Lookup(c) for c in tree.contexts]
    longer = [st.Lookup(s) for s in tree.sequences]
    for a in code.values():
        for b in code.values():
            total = 0.0
            for w in code.values():
                line = np.array([a, b, w], np.uint64)
                h = st.grams(line, np.arange(3), st.DEPTH)
                value = 0.0
                for depth in (1, 2):
                    at, k = contexts[depth - 1].find(h[depth - 1][1:2])
                    if len(at):
                        value += tree.discounts[depth - 1][k[0]]
                        at, k = longer[depth - 1].find(h[depth][2:3])
                        if len(at):
                            value = tree.ratios[depth - 1][k[0]]
                root = (1 - unseen) * counts[int(st.grams(np.array([w], np.uint64), np.zeros(1, int), 0)[0][0])] / len(flat)
                total += root * 10 ** value
            # The unknown symbol takes the rest, which every state leaves to the root by its discounts.
            value = 0.0
            h = st.grams(np.array([a, b], np.uint64), np.arange(2), st.DEPTH)
            for depth in (1, 2):
                at, k = contexts[depth - 1].find(h[depth - 1][1:2])
                value += tree.discounts[depth - 1][k[0]] if len(at) else 0.0
            assert math.isclose(total + unseen * 10 ** value, 1.0, rel_tol=1e-6)


def test_repeated_rows_empty_and_clashing(spark, docs):
    texts = ["a b c"] * 3 + [None]
    rows = st.score(docs(texts, ids=[7, 7, 8, None])).collect()
    assert len(rows) == 4 and len({(r["doc_id"], r["base_score"]) for r in rows}) == 3
    assert st.score(docs([])).count() == 0
    df = spark.createDataFrame([(1, "a a", 2, 3, 4)], "doc_id bigint, text string, key int, held int, gain int")
    assert [r["n_tokens"] for r in st.score(df).collect()] == [3]


def test_sequences_are_counted_over_all_partitions(spark, docs):
    """A passage that no partition sees twice counts as often as it occurs in all."""
    rng = random.Random(9)
    texts = [" ".join([f"x{rng.random()}", "one", "even", "longer", "passage", f"y{rng.random()}"]) for _ in range(24)]
    taught = [t for i, t in enumerate(texts) if not held(i)]
    exact = Counter(w[k:k + n] for n in (2, 3, 4) for w in [tuple(t.split()) + ("</s>",) for t in taught]
                    for k in range(len(w) - n + 1))
    exact = sorted(c for c in exact.values() if c >= st.LEAST)
    results = []
    for parts in (1, 24):
        df = docs(texts).repartitionByRange(parts, "doc_id")
        results.append({r["doc_id"]: (r["states"], round(r["score"], 9)) for r in st.score(df).collect()})
    assert results[0] == results[1] and results[1][0][0] == 3
    rows = df.selectExpr("doc_id as key", "text", "crc32(cast(doc_id as string)) % 5 = 1 as held")
    sums = st.gather(rows, 5).groupBy("part").applyInArrow(st._sums, st.SUMS).where("gram is not null")
    found = st.sequences(rows, sums.select("gram", "size", "count")).where("size > 1").collect()
    assert exact and sorted(r["count"] for r in found) == exact


def test_the_table_of_weights_is_the_tree(spark, docs):
    """The distributed tree scores texts as the tree in memory does, place by place."""
    texts = corpus(300) + ["a b c d a b c d", "d b c e d b c e"] * 20
    df = docs(texts).repartition(5)
    rows = df.selectExpr("doc_id as key", "text", "doc_id", "crc32(cast(doc_id as string)) % 5 = 1 as held")
    sums = st.gather(rows.select("key", "text", "held"), 5).groupBy("part").applyInArrow(st._sums, st.SUMS).where("gram is not null")
    found = st.reliable(st.sequences(rows, sums.select("gram", "size", "count")))
    tokens, unseen = 9000, 0.01
    table = found.toArrow()
    seq = {c: table[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("gram", "context", "shorter", "next")}
    seq["size"] = table["size"].to_numpy()
    tree = st.grow(seq, dict(zip(seq["gram"].tolist(), table["count"].to_pylist(), strict=True)), tokens, unseen)
    weighed, states = st.weights(found, tokens, unseen)
    assert states == sum(len(c) for c in tree.contexts) and all(len(c) for c in tree.contexts[:2])
    contexts, longer = [st.Lookup(c) for c in tree.contexts], [st.Lookup(s) for s in tree.sequences]
    got = {r["key"]: r["gain"] for r in st.adjustments(rows, weighed, "doc_id").collect()}
    for i, t in enumerate(texts):
        flat, place, _ = st._places([(t or "").encode()], st.WordHashes())
        g = st.grams(flat, place, st.DEPTH)
        gain = 0.0
        for x in range(len(flat)):
            value = 0.0
            for depth in range(1, min(x, st.DEPTH) + 1):
                at, k = contexts[depth - 1].find(g[depth - 1][x - 1:x])
                if len(at):
                    value += tree.discounts[depth - 1][k[0]]
                    at, k = longer[depth - 1].find(g[depth][x:x + 1])
                    value = tree.ratios[depth - 1][k[0]] if len(at) else value
            gain += value
        assert math.isclose(got[i], gain, rel_tol=1e-9, abs_tol=1e-9)


def test_joined_weights_score_as_those_sent_to_tasks(spark, docs, monkeypatch):
    texts = corpus() + ["Once upon A time there was one"] * 2
    df = docs(texts, ids=[*range(len(texts) - 1), len(texts) - 2])
    results = []
    for hot in (st.HOT, 5, 0):
        monkeypatch.setattr(st, "HOT", hot)
        results.append(sorted((r["doc_id"], round(r["score"], 8), r["states"]) for r in st.score(df).collect()))
    assert results[0] == results[1] == results[2]


def test_states_do_not_depend_on_the_size_of_the_corpus(docs):
    """Eight occurrences pay for a state beside three million other words as they do beside few."""
    passage = [i for i in range(40) if not held(i)][:8]
    for filler in (50, 100_000):
        texts = ["pad " * filler + ("rare bird" if i in passage else "pad") for i in range(40)]
        rows = {r["doc_id"]: r for r in st.score(docs(texts)).collect()}
        assert rows[0]["states"] >= 1
        plain = next(i for i in range(40) if i not in passage and not held(i))
        assert rows[passage[0]]["train_tokens"] > 30 * filler
        # "bird" is nearly certain after "rare"; what is left is the price of "rare" itself.
        lost = rows[plain]["score"] - rows[passage[0]]["score"]
        assert lost < 1.2 * math.log10(rows[0]["train_tokens"] / 8)


def test_what_is_counted_first_grows_with_distinct_words_not_with_texts(docs):
    """Texts of the same words send no more than one of them does: words are summed before they are dealt."""
    words = " ".join(f"w{k}" for k in range(400))
    sizes = []
    for n in (4, 40):
        ids = [i for i in range(100) if not held(i)][:n]
        rows = docs([words] * n, ids=ids).coalesce(1).selectExpr("doc_id as key", "text", "false as held")
        sizes.append(sum(len(c) for r in st.gather(rows, 5).collect() for c in (r[x] for x in st.CELLS) if c))
    assert sizes[1] < 1.1 * sizes[0]


def test_a_sequence_is_sent_as_its_hash_and_first_word(docs):
    """What else is known of a sequence follows from these, or is read off the shorter one where all are counted."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = docs([" ".join(rng.choices(words, k=3000)) for _ in range(8)]).coalesce(1).selectExpr("doc_id as key", "text", "false as held")
    often = st.gather(rows, 2).groupBy("part").applyInArrow(st._sums, st.SUMS).where("gram is not null").select("gram", "size", "count")
    pairs = often.where("size = 2")
    cells = st.candidates(rows, pairs, 2).collect() + st.candidates(rows, pairs, 2, 2, (4,)).collect()
    sent = sum(len(r[c]) for r in cells for c in st.CELLS if r[c])
    assert {r["size"] for r in cells} == {2, 3, 4} and sent < 17 * sum(len(r["a"]) // 8 for r in cells)
    found = {r["gram"]: r for r in st.sequences(rows, often).collect()}
    for r in found.values():
        if r["size"] > 1:
            first, longer = (np.array([r[c]], np.int64).view(np.uint64) for c in ("context", "gram"))
            assert found[r["context"]]["size"] == found[r["shorter"]]["size"] == r["size"] - 1 and found[r["next"]]["size"] == 1
            assert r["size"] > 2 or st._without(st.unmix(first) - st._STEP[0], longer).view(np.int64)[0] == r["shorter"] == r["next"]
            assert r["size"] == 2 or found[r["context"]]["shorter"] == found[r["shorter"]]["context"]


def test_words_are_told_apart_as_by_splitting():
    """Words hashed all at once are the words of split(), of any length and with any other bytes."""
    rng = random.Random(6)
    stems = [b"\0", b"\0" * 8, b"a", b"A", b"a\0", b"\x1c", b"\xc2\xa0", "é".encode(), "É".encode(), b"x" * 300]
    stems += [bytes(rng.choice(b"abZ\0\xff") for _ in range(n)) for n in (7, 8, 8, 9, 15, 16, 16, 17, 17, 24) for _ in range(3)]
    texts = [None, b"", b" \n\x0b", b"a"] + [
        b"".join(rng.choice(stems) + rng.choice([b" ", b"\t\r\n", b"\x0b", b"\x0c "]) for _ in range(50)) for _ in range(9)]
    for some in ([], texts, texts[::-1], [b" a", b"a "]):
        flat, place, lengths = st._places(some, st.WordHashes())
        words = [w for t in some for w in [*(t or b"").lower().split(), st.END]]
        assert lengths.tolist() == [len((t or b"").split()) + 1 for t in some]
        assert place.tolist() == [k for n in lengths.tolist() for k in range(n)]
        pairs = set(zip(words, flat.tolist(), strict=True))
        assert len(pairs) == len(set(words)) == len(set(flat.tolist()))


def test_places_of_cold_weights_are_sent_in_pieces(docs, monkeypatch):
    """Texts get the same sums when a task deals its places out many times."""
    df = docs(corpus(1200)).coalesce(1)
    results = []
    for hot, pool in ((st.HOT, st.POOL), (0, st.POOL), (0, 100)):
        monkeypatch.setattr(st, "HOT", hot)
        monkeypatch.setattr(st, "POOL", pool)
        results.append(sorted((r["doc_id"], r["n_known"], round(r["base_score"], 7), round(r["score"], 7)) for r in st.score(df).collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == 1204
