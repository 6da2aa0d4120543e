"""The permutation against plain code, and what holds for every assignment."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from measureloom.llm import ranks, sharding


def plain(total, seed):
    """The permutation of 0..total-1 as a list."""
    half = 1
    while 4 ** half < total:
        half += 1
    low = 2 ** half - 1

    def network(x):
        a, b = x >> half, x & low
        for key in sharding.round_keys(seed):
            m = ((b ^ key) & 0x7FFFFFFF) * 0x9E3779B1
            m = ((m >> 16) ^ (m >> 33)) & 0x7FFFFFFF
            a, b = b, a ^ ((m * 0x85EBCA6B >> 17) & low)
        return (a << half) + b

    out = []
    for n in range(total):
        x = network(n)
        while x >= total:
            x = network(x)
        out.append(x)
    return out


def test_permutation_and_back(spark):
    for total in (1, 2, 3, 4, 5, 16, 17, 1000):
        value = sharding.permuted(F.col("id"), total, 7)
        got = spark.range(total).select("id", value.alias("v")).withColumn(
            "back", sharding.restored(F.col("v"), total, 7)).orderBy("id").collect()
        assert [r["v"] for r in got] == plain(total, 7)
        assert sorted(r["v"] for r in got) == list(range(total))
        assert all(r["back"] == r["id"] for r in got)
    assert plain(1000, 7) != plain(1000, 8)


def test_slots_lead_back_to_rows(spark):
    value = sharding.permuted(F.col("id"), 100, 1)
    shard, slot = sharding.shard_and_slot(F.col("v"), 7)
    got = spark.range(100).select("id", value.alias("v")).select("id", shard.alias("s"), slot.alias("t")).withColumn(
        "back", sharding.number_at(F.col("s"), F.col("t"), 100, 7, 1))
    assert all(r["back"] == r["id"] for r in got.collect())
    assert spark.range(1).select(sharding.permuted(F.lit(None).cast("long"), 5, 1)).first()[0] is None


def rows(seed, count=300):
    rng = random.Random(seed)
    out = [(rng.choice([None, rng.randrange(1000)]), rng.choice([None, "", "a", "é" * rng.randrange(40)]), rng.randrange(3)) for _ in range(count)]
    return out + [(5, "hot", 1)] * count


SCHEMA = "doc_id long, text string, slot long"


def expected(data, shards, seed):
    """Shard and slot of the sorted rows."""
    data = sorted(data)
    place = plain(len(data), seed)
    return Counter((r, place[n] % shards, place[n] // shards) for n, r in enumerate(data))


def test_whole_assignment_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranks, "REPEATS", 64)
    data = [(0 if d is None else d, t or "", k) for d, t, k in rows(3)]
    for parts in (1, 5):
        df = spark.createDataFrame(data, "doc_id long, text string, k long").repartition(parts)
        got = Counter(((r["doc_id"], r["text"], r["k"]), r["shard"], r["slot"]) for r in sharding.assign(df, ["doc_id"], 7, 9).collect())
        assert got == expected(data, 7, 9)


def test_nulls_repeats_and_clashing_names(spark):
    data = rows(4)
    df = spark.createDataFrame(data, SCHEMA).withColumn("_number", F.lit(1)).withColumn("_row", F.lit("x"))
    found = sharding.assign(df, ["doc_id", "text"], 16, 0)
    assert found.columns == ["doc_id", "text", "_number", "_row", "shard", "slot"]
    got = found.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((d, t) for d, t, _ in data)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_no_rows_and_fewer_rows_than_shards(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
    got = sharding.assign(spark.createDataFrame([(1, None, None), (2, "x", 1)], SCHEMA), ["doc_id"]).collect()
    assert all(r["slot"] == 0 for r in got) and len({r["shard"] for r in got}) == 2


def test_files_hold_ranges_of_slots(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    sharding.write_shards(sharding.assign(df, ["doc_id"], 4, 2), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


def test_functions_only(spark):
    df = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    plan = sharding.assign(df, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rank_of_weighted_groups(spark):
    data = [(g, v, v % 3 + 1) for g in (None, "a", "b") for v in range(40)]
    df = spark.createDataFrame(data, "g string, v long, w long")
    got = {(r["g"], r["v"]): r["n"] for r in ranks.before(df, ["g"], ["v"], "n", "w").collect()}
    assert got == {(g, v): sum(k % 3 + 1 for k in range(v)) for g, v, _ in data}
