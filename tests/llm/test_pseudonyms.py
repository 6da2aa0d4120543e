"""Permutations, validity and round trips."""

import random
from datetime import date

import pytest

from measureloom.llm import pseudonyms as ps

KEY = b"a key of a test"


def test_the_network_permutes():
    for size in (1, 2, 7, 30, 257):
        image = [ps.permute(k, size, KEY, "t") for k in range(size)]
        assert sorted(image) == list(range(size))
        assert [ps.permute(v, size, KEY, "t", back=True) for v in image] == list(range(size))


VALUES = ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005", "jo.doe+7@mail.example.org", "+1 (212) 555-0147",
          "(212) 555-0147", "212-555-0147", "10.0.0.1", "DE89 3704 0044 0532 0130 00", "078-05-1120", "2024-02-29", "01/31/1999",
          "31/12/1999", "24.12.2001", "+49 30 1234567"]


@pytest.mark.parametrize("value", VALUES)
def test_round_trip_within_the_format(value):
    text = f"Before {value}, after"
    found = ps.find(text, KEY)
    assert [text[a:b] for a, b, _, _ in found] == [value]
    new = ps.replaced(text, found)
    assert new != text and len(new) - len(text) in ((0,) if found[0][2] != "ip" else range(-8, 9))
    again = ps.find(new, KEY)
    assert [k for _, _, k, _ in again] == [found[0][2]]  # valid again, and of the same kind
    assert ps.replaced(new, ps.find(new, KEY, back=True)) == text


def test_invalid_values_stay():
    for value in ("4111111111111112", "2023-02-29", "13/32/2020", "300.1.1.1", "DE00370400440532013000", "000-12-3456", "1850-01-01",
                  "1111111111111", "v1.2.3.4.5", "a@b"):
        assert not ps.find(f"x {value} y", KEY), value


def test_equal_values_stay_linked_and_different_ones_apart():
    rng = random.Random(1)
    heads = {"".join(rng.choice("0123456789") for _ in range(15)) for _ in range(500)}
    cards = [h + str(ps.luhn(h)) for h in heads]
    image = {c: ps.find(c, KEY)[0][3] for c in cards}
    assert len(set(image.values())) == len(cards)
    one = cards[0]
    spaced = " ".join(one[k:k + 4] for k in range(0, 16, 4))
    assert ps.find(spaced, KEY)[0][3].replace(" ", "") == image[one]
    assert ps.find(one, b"another key")[0][3] != image[one]
    days = {ps.find(date.fromordinal(d).isoformat(), KEY)[0][3] for d in range(730_000, 731_000)}
    assert len(days) == 1000


def test_rows(docs):
    texts = [None, "", "no data", "mail a.b@c.org and 4111111111111111", "x" * 100_000 + " 4111111111111111", "4111111111111111"]
    rows = {r["doc_id"]: r for r in ps.pseudonymise(docs(texts), KEY).collect()}
    assert rows[0]["text"] is None and rows[0]["spans"] == [] and rows[2]["text"] == "no data"
    assert [s["kind"] for s in rows[3]["spans"]] == ["email", "card"]
    assert rows[4]["text"].split()[1] == rows[5]["text"] == rows[3]["spans"][1]["pseudonym"]
    back = ps.pseudonymise(ps.pseudonymise(docs(texts), KEY), KEY, back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    assert ps.pseudonymise(docs([]), KEY).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(None, "10.0.0.1", 1, 2)], "doc_id bigint, text string, spans int, id int")
    assert [len(r["spans"]) for r in ps.pseudonymise(df, KEY).collect()] == [1]
