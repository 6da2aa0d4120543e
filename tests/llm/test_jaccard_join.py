"""The heavy-light join against all pairs of small fixtures."""

import random

import numpy as np
import pytest

from measureloom.llm import jaccard_join as jj


def sets(texts, width=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def expected(texts, ids, percent=75):
    found, root = sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= percent * (len(found[i] | found[j])):
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(found[i]), low[find(i)]) for i, d in enumerate(ids))


def run(docs, texts):
    got = jj.link(docs(texts)).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "One", "one", "a b", "A  b", "a b c d", "a b c d e", "x y z"]
    passage = [rng.choice(words) for _ in range(30)]
    for size in (6, 7, 8, 9, 11, 12, 14, 16, 20, 60, 120):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])] = rng.choice(words)
                texts.append(" ".join(copy[:-1] if rng.random() < 0.3 else copy))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(8)]) for _ in range(6)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(docs, seed):
    texts = corpus(seed)
    assert run(docs, texts) == expected(texts, range(len(texts)))


@pytest.mark.parametrize("wide", [20, 300])
def test_long_lists_are_joined_by_leaders_and_stay_exact(docs, monkeypatch, wide):
    monkeypatch.setattr(jj, "WIDE_FROM", wide)
    monkeypatch.setattr(jj, "BLOCK", 16)
    monkeypatch.setattr(jj, "LONG_LIST", 5)
    monkeypatch.setattr(jj, "STAR", 4)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(90)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(45):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(copy))
    assert run(docs, texts) == expected(texts, range(len(texts)))


def test_empty_table(docs):
    assert run(docs, []) == []


def test_repeated_and_null_ids(docs):
    text = "a b c d e f g"
    got = jj.link(docs([text, text, text, None], ids=[5, 5, None, None]))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == [
        ("5", 3, "5"), ("5", 3, "5"), ("None", 0, "None"), ("None", 3, "5")]


def test_clashing_columns(spark):
    names = "doc_id bigint, text string, sid string, n string, id string, a int, lead int, root int, salt int, range int"
    df = spark.createDataFrame([(k, "p q r s t u v", "x", "y", "z", 1, 2, 3, 4, 5) for k in (3, 4)], names)
    assert {tuple(r) for r in jj.link(df).collect()} == {(3, 3, 3), (4, 3, 3)}


def test_subsets_prove_exactly_the_links():
    for percent in (60, 75, 90):
        for a in range(1, 13):
            for lo, hi, c in jj.subset_plan(a, percent, 12):
                assert 100 * c >= percent * (lo + hi - c) and 100 * (c - 1) < percent * (lo + hi - c + 1)


def test_boundary_follows_cost():
    assert jj.boundary({}, 75) >= 1
    assert jj.boundary({n: 100 for n in range(1, 7)}, 75) >= 6
    assert jj.boundary({12: 10_000}, 75) < 12


def test_histograms_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.integers(0, 2**63, rng.integers(8, 400)).astype(np.uint64)
        y = np.concatenate([x[: max(1, int(len(x) * 0.9))], rng.integers(0, 2**63, 4).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            bins = [np.frombuffer(jj.histogram_of(s), np.uint8)[None] for s in (x, y)]
            assert jj._possible(*bins, np.array([len(x)]), np.array([len(y)]), 75).all()


@pytest.mark.parametrize("long_list", [40, 3])
def test_large_sets_that_cannot_link_are_not_read_again(docs, monkeypatch, long_list):
    """Sets of thousands that share a passage are ruled out by their histograms, in pairs and in long lists."""
    monkeypatch.setattr(jj, "LONG_LIST", long_list)
    rng = random.Random(11)
    passage = [f"p{rng.random()}" for _ in range(400)]
    texts = [" ".join(passage + [f"w{rng.random()}" for _ in range(size)]) for size in (3600, 3700, 4000, 4100, 4300, 4600)]
    near = texts[0].split()
    texts.append(" ".join(near[:3000] + ["other"] + near[3000:]))
    sent, plain = [], jj.sets_for

    def counted(roles, *rest):
        sent.append(roles.select("sid").distinct().count())
        return plain(roles, *rest)

    monkeypatch.setattr(jj, "sets_for", counted)
    assert run(docs, texts) == expected(texts, range(len(texts)))
    assert sum(sent) == 2


def test_folded_histograms_bound_sets_of_other_sizes():
    rng = np.random.default_rng(1)
    for n in (500, 512, 513, 1030, 5000, 16_400):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.concatenate([x[: int(n * 0.92)], rng.integers(0, 2**63, n // 50).astype(np.uint64)])
        wide = [np.frombuffer(jj.histogram_of(s, jj.wide_bins(len(s))), np.uint8)[None] for s in (x, y)]
        assert jj._possible(*wide, len(x), np.array([len(y)]), 75).all()
        assert jj._possible(*wide[::-1], len(y), np.array([len(x)]), 75).all()
