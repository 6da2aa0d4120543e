import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from measureloom.contract import TOTAL, Measure, Scope
from measureloom.operators import aggregate as a
from measureloom.operators import scope as s
from measureloom.operators.compare import member_comparison, price_volume_mix, total_comparison
from measureloom.operators.quantiles import exact_quantiles

D = dt.date
SNAPSHOT = Scope(mode="snapshot")


def values(facts, dimension):
    return {r["name"]: r["current"] for r in facts.where(F.col("dimension") == dimension).collect()}


def test_ending_inventory(make):
    df = make("date date, depot string, barrels int", [
        (D(2022, 6, 4), "quay", 31), (D(2022, 6, 4), "mill", 7), (D(2022, 6, 18), "mill", 3),
        (D(2022, 6, 29), "quay", 12), (D(2022, 6, 29), "mill", 16)])
    m = Measure("barrels", "barrels", "sum", additivity="semi_additive", time_aggregation="ending")
    lock = s.resolve(df, Scope(period="2022-06", data_as_of="2022-06-30"), "date")
    facts = a.member_facts(df, [m], ["depot"], lock, "date")
    assert values(facts, TOTAL) == {TOTAL: 28.0}
    assert values(facts, "depot") == {"quay": 12.0, "mill": 16.0}


def test_members_without_the_last_day_report_their_own(make):
    df = make("date date, facility string, on_hand int", [
        (D(2025, 3, 1), "A", 10), (D(2025, 3, 31), "B", 25), (D(2025, 3, 31), "A", None)])
    m = Measure("on_hand", "on_hand", "sum", additivity="semi_additive", time_aggregation="ending")
    lock = s.resolve(df, Scope(period="2025-03", data_as_of="2025-03-31"), "date")
    facts = a.member_facts(df, [m], ["facility"], lock, "date")
    assert values(facts, "facility") == {"A": 10.0, "B": 25.0}
    assert values(facts, TOTAL) == {TOTAL: 25.0}


def test_ratio_and_fraction_scale(make):
    df = make("line string, broken int, made int, filled double", [
        ("north", 3, 40, 0.2), ("south", 5, 60, 0.6), ("west", 0, 100, 0.7)])
    ratio = Measure("broken_rate", None, "ratio", "percent", "lower_is_better", "non_additive",
                    "defect_rate", numerator_field="broken", denominator_field="made",
                    storage_scale="fraction")
    mean = Measure("filled", "filled", "mean", "percent", "higher_is_better",
                   "non_additive", "percentage", storage_scale="fraction")
    facts = a.member_facts(df, [ratio, mean], ["line"], s.resolve(df, SNAPSHOT, None), None)
    got = {r["measure_id"]: r["current"] for r in facts.where(F.col("name") == TOTAL).collect()}
    assert got == {"broken_rate": pytest.approx(4.0), "filled": pytest.approx(50.0)}


def test_dimensions_named_like_result_columns(make):
    df = make("d date, name string, dimension string, in_current string, value string, v double", [
        (D(2025, 1, 2), "a", "p", "x", "m", 2.0), (D(2025, 1, 9), "b", "p", "y", "m", 4.0),
        (D(2025, 2, 1), "a", "q", "y", "n", 8.0)])
    lock = s.resolve(df, Scope(period="2025Q1", data_as_of="2025-03-31"), "d")
    for how in ("sum", "median", "distinct_count"):
        facts = a.member_facts(df, [Measure("t", "v", how)], ["name", "dimension", "in_current"], lock, "d")
        got = {(r["dimension"], r["name"]): r["current"] for r in facts.collect()}
        wanted = {"sum": 10.0, "median": 5.0, "distinct_count": 2.0}[how]
        assert got[("name", "a")] == wanted and len(got) == 7
        series = a.monthly_series(df, [Measure("t", "v", how)], "d", by=["value"])
        assert series.columns == ["measure_id", "member_value", "month", "value"]
        assert {(r[1], r[2].month) for r in series.collect()} == {("m", 1), ("n", 2)}


def test_null_members_counts_and_blank_sides(make):
    df = make("d date, zone string, v string", [
        (D(2025, 1, 1), None, "1"), (D(2025, 1, 1), "a", "x"), (D(2024, 1, 1), "b", "3")])
    lock = s.resolve(df, Scope(period="2025-01", comparison="yoy", data_as_of="2025-01-31",
                               comparison_as_of="2024-01-31"), "d")
    rows = a.member_facts(df, [Measure("n", "v", "count"), Measure("s", "v"),
                               Measure("u", "v", "distinct_count")], ["zone"], lock, "d")
    got = {(r[0], r[2]): (r[3], r[4]) for r in rows.where("dimension = 'zone'").collect()}
    assert got[("n", "(空值)")] == (1.0, None)
    assert got[("n", "a")] == (0.0, None)
    assert got[("n", "b")] == (None, 1.0)
    assert got[("s", "a")] == (None, None)
    assert got[("u", "a")] == (0.0, None)


def test_every_aggregation_against_python(spark):
    rng = random.Random(3)
    rows = [(D(2025, 1, 1 + rng.randrange(20)), rng.choice("abbbbb"), float(rng.randrange(-40, 40)),
             float(rng.randrange(0, 5))) for _ in range(800)]
    df = spark.createDataFrame(rows, "d date, k string, v double, w double")
    kinds = ["sum", "mean", "median", "min", "max", "count", "distinct_count", "weighted_mean"]
    ms = [Measure(k, "v", k, weight_field="w" if k == "weighted_mean" else None) for k in kinds]
    got = {r["k"]: r for r in a.grouped(df, ms, ["k"]).collect()}
    for key in "ab":
        v = [r[2] for r in rows if r[1] == key]
        w = [(r[2], r[3]) for r in rows if r[1] == key and r[3] > 0]
        wanted = {
            "sum": sum(v), "mean": statistics.fmean(v), "median": statistics.median(v),
            "min": min(v), "max": max(v), "count": len(v), "distinct_count": len(set(v)),
            "weighted_mean": sum(x * y for x, y in w) / sum(y for _, y in w)}
        for kind, value in wanted.items():
            assert got[key][kind] == pytest.approx(value), (key, kind)


def interpolated(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("shape", ["spread", "equal", "two_values", "outlier", "tiny_steps", "signs"])
def test_exact_quantiles_of_hot_groups(spark, shape):
    rng = random.Random(5)
    draw = {
        "spread": lambda: rng.uniform(-1e6, 1e6), "equal": lambda: 7.5,
        "two_values": lambda: rng.choice([0.0, 1.0]),
        "outlier": lambda: rng.choice([1e300, 1.0, 2.0, -1e-300, 0.0]),
        "tiny_steps": lambda: 1.0 + rng.randrange(5) * 2.0 ** -52,
        "signs": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 8),
    }[shape]
    rows = [("hot" if i % 3 else f"k{i % 7}", draw()) for i in range(3000)] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for key in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == key and r[1] is not None]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(interpolated(v, p), rel=1e-15, abs=1e-320)


def test_comparison_rows_and_suppressed_shares(make):
    df = make("d date, zone string, v double", [
        (D(2025, 1, 1), "n", 200.0), (D(2025, 1, 2), "s", -50.0), (D(2024, 1, 2), "n", 100.0),
        (D(2024, 1, 3), "gone", 10.0)])
    m = Measure("v", "v", direction="higher_is_better", primary=True)
    lock = s.resolve(df, Scope(period="2025-01", comparison="yoy", data_as_of="2025-01-31",
                               comparison_as_of="2024-01-31"), "d")
    facts = a.member_facts(df, [m], ["zone"], lock, "d")
    total = total_comparison(facts, [m]).head()
    assert (total["current"], total["baseline"]) == (150.0, 110.0)
    assert total["change_pct"] == pytest.approx(36.3636, abs=1e-4) and total["favorable"]
    rows = {r["name"]: r for r in member_comparison(facts, [m]).collect()}
    assert all(r["share"] is None for r in rows.values())
    assert rows["n"]["contribution_pp"] == pytest.approx(100 / 110 * 100)
    assert rows["gone"]["contribution_pp"] is None and rows["gone"]["delta"] is None


def test_shares_and_contributions_add_up(spark):
    rng = random.Random(1)
    rows = [(D(2024 + rng.randrange(2), 1, 5), rng.choice("abc"), rng.uniform(1, 9))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "d date, k string, v double")
    m = Measure("v", "v")
    lock = s.resolve(df, Scope(period="2025-01", comparison="yoy", data_as_of="2025-01-31",
                               comparison_as_of="2024-01-31"), "d")
    facts = a.member_facts(df, [m], ["k"], lock, "d")
    r = member_comparison(facts, [m]).agg(F.sum("share"), F.sum("contribution_pp")).head()
    assert r[0] == pytest.approx(100)
    assert r[1] == pytest.approx(total_comparison(facts, [m]).head()["change_pct"])


def test_price_volume_mix(make):
    df = make("date date, revenue int, units string", [
        (D(2025, 1, 1), 100, "10"), (D(2026, 1, 1), 132, "12")])
    amount = Measure("revenue", "revenue", semantic_type="amount", primary=True)
    units = Measure("units", "units", semantic_type="quantity")
    lock = s.resolve(df, Scope(period="2026-01", comparison="yoy", data_as_of="2026-01-31",
                               comparison_as_of="2025-01-31"), "date")
    row = price_volume_mix(df, amount, units, lock, "date").head()
    assert row["status"] == "OK"
    assert (row["volume_effect"], row["price_mix_effect"]) == (pytest.approx(20), pytest.approx(12))
    bad = df.withColumn("units", F.lit("n/a"))
    row = price_volume_mix(bad, amount, units, lock, "date").head()
    assert row["status"] == "BLOCKED" and row["qty_parse_error_pct"] == 100.0


def test_window_trend_marks_missing_months(make):
    df = make("d date, v int", [(D(2025, 1, 5), 1), (D(2025, 3, 5), 3)])
    rows = a.window_trend(df, Measure("v", "v"), "d", "2025-01-01", "2025-03-31")
    got = [(str(r[0]), r[1], r[2]) for r in rows.orderBy("month").collect()]
    assert got == [("2025-01-01", 1.0, False), ("2025-02-01", None, True), ("2025-03-01", 3.0, False)]


def rows_read(spark, action):
    """Rows that scans of files gave while the action ran."""
    def stages():
        gateway = spark.sparkContext._gateway
        store = spark.sparkContext._jsc.sc().statusStore()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.inputRecords()
                for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    before = stages()
    action()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("few", [True, False])
def test_all_kinds_of_measures_from_two_scans(spark, tmp_path, monkeypatch, few):
    from measureloom.operators import quantiles as q

    if not few:
        monkeypatch.setattr(q, "MAX_SENT", 0)
    rng = random.Random(8)
    rows = [(D(2024 + rng.randrange(2), 1, 1 + rng.randrange(9)), rng.choice(["n", "s", None]), rng.choice([None, rng.uniform(-9, 9), 2.0]))
            for _ in range(800)] + [(D(2025, 1, 3), "blank", None), (D(2024, 1, 3), "gone", 4.0)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, "d date, k string, v double").write.parquet(path)
    df = spark.read.parquet(path)
    kinds = {"sum": sum, "median": statistics.median, "distinct_count": lambda v: float(len(set(v))), "max": max}
    measures = [Measure(k, "v", k) for k in kinds] + [
        Measure("level", "v", "sum", additivity="semi_additive", time_aggregation="ending"),
        Measure("middle2", "v", "median")]
    lock = s.resolve(df, Scope(period="2025-01", comparison="yoy", data_as_of="2025-01-31", comparison_as_of="2024-01-31"), "d")
    got = {}

    def run():
        for r in a.member_facts(df, measures, ["k"], lock, "d").collect():
            got[r["measure_id"], r["dimension"], r["name"]] = r

    assert rows_read(spark, run) <= 2 * len(rows)
    members = {("k", k or "(空值)"): [r for r in rows if r[1] == k] for k in ("n", "s", None, "blank", "gone")} | {(TOTAL, TOTAL): rows}
    assert len(got) == len(measures) * len(members)
    for (dimension, name), mine in members.items():
        for side, year in (("current", 2025), ("baseline", 2024)):
            there = [r for r in mine if r[0].year == year]
            v = [r[2] for r in there if r[2] is not None]
            for kind, plain in kinds.items():
                want = None if not there else plain(v) if v or kind == "distinct_count" else None
                row = got[kind, dimension, name]
                assert row[side] == (pytest.approx(want) if want is not None else None), (kind, name, side)
                assert row["in_current" if side == "current" else "in_base"] == bool(there)
            assert got["middle2", dimension, name][side] == got["median", dimension, name][side]
            days = sorted({r[0] for r in there if r[2] is not None})
            want = sum(r[2] for r in there if r[0] == days[-1] and r[2] is not None) if days else None
            assert got["level", dimension, name][side] == (pytest.approx(want) if want is not None else None)


def test_quantiles_move_counters_and_not_values(spark, tmp_path):
    path = str(tmp_path / "v.parquet")
    spark.range(20_000).selectExpr("cast(id % 97 as double) v").write.parquet(path)
    df = spark.read.parquet(path)
    # Whole numbers below the buckets of an octave are settled by one scan.
    assert rows_read(spark, lambda: exact_quantiles(df, [], "v", {"m": 0.5}).collect()) == 20_000
    spark.range(20_000).selectExpr("id / 7 as v").write.parquet(path + "2")
    df = spark.read.parquet(path + "2")
    assert rows_read(spark, lambda: exact_quantiles(df, [], "v", {"m": 0.5}).collect()) == 40_000


def test_facts_and_series_from_one_scan(spark, tmp_path):
    rng = random.Random(4)
    rows = [(D(2024 + rng.randrange(2), rng.randrange(1, 13), 5), rng.choice(["n", "s", None]), rng.choice([None, rng.uniform(-9, 9)]))
            for _ in range(400)] + [(None, "n", 5.0)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, "d date, k string, v double").write.parquet(path)
    df = spark.read.parquet(path)
    lock = s.resolve(df, Scope(period="2025Q1", comparison="yoy", data_as_of="2025-03-31", comparison_as_of="2024-03-31"), "d")
    for measures in ([Measure("v", "v"), Measure("m", "v", "mean")], [Measure("v", "v"), Measure("mid", "v", "median")]):
        found = []
        read = rows_read(spark, lambda measures=measures, found=found: found.extend(
            sorted(map(str, f.select(sorted(f.columns)).collect())) for f in a.facts_and_series(df, measures, ["k"], lock, "d")))
        if all(m.aggregation != "median" for m in measures):
            assert read == len(rows)
        plain = (a.member_facts(df, measures, ["k"], lock, "d"), a.monthly_series(df, measures, "d"))
        assert [len(mine) for mine in found] == [wanted.count() for wanted in plain]
    facts, series = a.facts_and_series(df, [Measure("v", "v")], ["k"], lock, "d")
    total = facts.where(F.col("dimension") == TOTAL).head()
    assert total["current"] == pytest.approx(sum(r[2] for r in rows if r[0] and r[0].year == 2025 and r[0].month <= 3 and r[2] is not None))
    for r in series.collect():
        assert r["value"] == pytest.approx(sum(x[2] for x in rows if x[0] and x[0].replace(day=1) == r["month"] and x[2] is not None))


ALL_SUMS = [
    Measure("s", "v", "sum"), Measure("m", "v", "mean"), Measure("n", "v", "count"), Measure("lo", "v", "min"),
    Measure("hi", "v", "max"), Measure("w", "v", "weighted_mean", weight_field="q"),
    Measure("r", None, "ratio", "percent", numerator_field="v", denominator_field="q")]


def test_few_combinations_are_combined_before_the_grouping_sets(spark, monkeypatch):
    rng, start = random.Random(5), D(2024, 1, 1)
    rows = [(start + dt.timedelta(days=rng.randrange(500)) if rng.random() < 0.99 else None, rng.choice(["x", "y", None]),
             rng.choice([None, 0.1, 0.2, -7.35, 1e-9, 3e17]), rng.choice([None, 0.0, -1.0, 2.5, 4.0])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "d date, k string, v double, q double")
    lock = s.resolve(df, Scope(period="2025Q1", comparison="yoy", data_as_of="2025-03-31", comparison_as_of="2024-03-31"), "d")
    combined, real = [], a._crossed
    monkeypatch.setattr(a, "_crossed", lambda *args: combined.append(args) or real(*args))
    facts, series = a.facts_and_series(df, ALL_SUMS, ["k"], lock, "d", cheap=True)
    assert len(combined) == 1
    plain, monthly = a.facts_and_series(df, ALL_SUMS, ["k"], lock, "d")
    assert len(combined) == 1
    for got, wanted, by in ((facts, plain, ["measure_id", "dimension", "name"]), (series, monthly, ["measure_id", "month"])):
        got, wanted = got.orderBy(*by).collect(), wanted.orderBy(*by).collect()
        assert len(got) == len(wanted) > 7
        for x, y in zip(got, wanted):
            assert all(u == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v) for u, v in zip(x, y))


def test_many_combinations_go_straight_to_the_grouping_sets(make, monkeypatch):
    df = make("d date, k string, v double", [(D(2025, 1, 1 + i % 28), f"k{i}", 1.0) for i in range(100)])
    lock = s.resolve(df, Scope(period="2025Q1", data_as_of="2025-03-31"), "d")
    monkeypatch.delattr(a, "_crossed")
    facts, _ = a.facts_and_series(df, [ALL_SUMS[0]], ["k"], lock, "d", cheap=True)
    assert values(facts, TOTAL) == {TOTAL: 100.0}
