import datetime as dt
import random
import statistics as pystats

import pytest
from pyspark.sql import functions as F

from measureloom.contract import Measure
from measureloom.operators import shape as g
from measureloom.operators import statistics as s
from measureloom.operators.compare import yoy_series

# Eighteen monthly year-over-year points with a known verdict.
GOLDEN = [30.0, 27.5, 25.1, 22.6, 20.1, 17.6, 15.2, 12.7, 10.2, 7.8, 5.3, 2.8, 0.4, -45.0, -4.6,
          -7.1, -9.5, -12.0]
M = Measure("m", "v", direction="higher_is_better", primary=True)


def month(i, year=2025):
    return dt.date(year + i // 12, i % 12 + 1, 1)


def series(make, values, start=0, name="m"):
    return make("measure_id string, month date, value double",
                [(name, month(start + i), v) for i, v in enumerate(values)])


def test_golden_trend(make):
    row = s.mann_kendall(series(make, GOLDEN), ["measure_id"]).head()
    assert (row["n"], row["s"], round(row["z"], 2)) == (18, -145, -5.45)
    assert row["direction"] == "decreasing" and row["significant"] and round(row["p"], 4) == 0.0


def test_golden_anomaly_and_run(make):
    df = series(make, GOLDEN)
    found = s.anomalies(s.robust_z(df, ["measure_id"])).collect()
    assert [(str(r["month"]), r["value"], round(r["robust_z"], 2)) for r in found] == [
        ("2026-02-01", -45.0, -2.95)]
    assert g.trailing_negative_run(df, ["measure_id"]).head()["trailing_negative"] == 5


def test_reading(make):
    readings = s.trend_reading(s.mann_kendall(series(make, GOLDEN), ["measure_id"]), [M]).head()
    assert readings["business_favorable"] is False
    assert readings["reading"] == "trend_not_fluctuation"
    short = s.trend_reading(s.mann_kendall(series(make, [1.0, 2.0, 3.0, 4.0]), ["measure_id"]), [M]).head()
    assert (short["direction"], short["significant"], short["reading"]) == (
        "increasing", False, "direction_only")


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0], [5.0] * 9])
def test_insufficient(make, values):
    row = s.mann_kendall(series(make, values), ["measure_id"]).head()
    assert (row["direction"], row["s"], row["z"], row["significant"]) == (
        "insufficient_sample", None, None, False)


def test_trend_score_against_pairs(spark):
    rng = random.Random(2)
    rows = [(k, month(i), float(rng.randrange(12))) for k in "ab" for i in range(60)]
    got = {r["k"]: r["s"] for r in s.mann_kendall(
        spark.createDataFrame(rows, "k string, month date, value double"), ["k"]).collect()}
    for k in "ab":
        v = [r[2] for r in rows if r[0] == k]
        assert got[k] == sum((v[j] > v[i]) - (v[j] < v[i]) for i in range(60) for j in range(i)) * -1


def test_robust_z_fallbacks(make):
    z = [r["robust_z"] for r in s.robust_z(series(make, [1.0, 1.0, 1.0, 1.0, 9.0]), ["measure_id"]).orderBy(
        "month").collect()]
    assert z[0] == 0 and z[4] == pytest.approx(8 / (1.2533 * 1.6))
    assert {r["robust_z"] for r in s.robust_z(series(make, [2.0] * 5), ["measure_id"]).collect()} == {0.0}


def test_yoy_guards(make):
    df = make("measure_id string, month date, value double", [
        ("m", dt.date(2024, 1, 1), -1.0), ("m", dt.date(2024, 2, 1), 10.0),
        ("m", dt.date(2024, 3, 1), 10.0), ("m", dt.date(2025, 1, 1), 1.0),
        ("m", dt.date(2025, 2, 1), -1.0), ("m", dt.date(2025, 3, 1), 20.0),
        ("m", dt.date(2027, 3, 1), 40.0)])
    assert [(str(r["month"]), r["value"]) for r in yoy_series(df).collect()] == [("2025-03-01", 100.0)]


def test_trailing_run_needs_adjacent_months(make):
    gap = make("k string, month date, value double", [
        ("a", dt.date(2025, 1, 1), -1.0), ("a", dt.date(2025, 3, 1), -2.0),
        ("b", dt.date(2024, 12, 1), -1.0), ("b", dt.date(2025, 1, 1), -2.0),
        ("b", dt.date(2025, 2, 1), -3.0), ("c", dt.date(2025, 2, 1), 3.0)])
    got = {r[0]: r[1] for r in g.trailing_negative_run(gap, ["k"]).collect()}
    assert got == {"a": 1, "b": 3, "c": 0}


def test_trend_source_prefers_yoy_then_gapless_months(make):
    rows = [("long", month(i), 1.0 + i) for i in range(15)]
    rows += [("short", month(i), 1.0 + i) for i in range(5)]
    rows += [("gap", month(i), 1.0) for i in (0, 1, 2, 4)]
    df = make("measure_id string, month date, value double", rows)
    got = s.trend_source(df).groupBy("measure_id", "series").agg(F.count("*").alias("n")).collect()
    assert {(r[0], r[1], r[2]) for r in got} == {
        ("long", "monthly_yoy_pct", 3), ("short", "regular_monthly_value", 5)}


@pytest.mark.parametrize("shares, hhi, level", [
    ([18.0, 25.0, 20.0, 17.0, 20.0], 0.204, "高集中"), ([22.0, 48.0, 30.0], 0.369, "高集中"),
    ([23.0, 39.0, 38.0], 0.349, "高集中"), ([60.0, 40.0], 0.52, "高集中")])
def test_golden_hhi(make, shares, hhi, level):
    rows = make("measure_id string, dimension string, share double", [("m", "d", x) for x in shares])
    row = s.herfindahl(rows, 0.1, 0.18, digits=1).head()
    assert (round(row["hhi"], 3), row["level"]) == (hhi, level)
    assert s.herfindahl(rows, 0.5, 0.9).head()["level"] == ("中度集中" if hhi > 0.5 else "分散")
    assert s.herfindahl(rows).head()["level"] is None


def test_policy_thresholds_are_checked(make):
    rows = make("measure_id string, dimension string, share double", [("m", "d", 1.0)])
    for pair in ((0.1, None), (0.5, 0.2), (0.1, 1.5)):
        with pytest.raises(ValueError):
            s.herfindahl(rows, *pair)


def test_scan_by_direction(make):
    rows = make("measure_id string, dimension string, name string, change_pct double, share double,"
                "delta double, contribution_pp double", [
                    ("m", "d", "bad", -20.0, 5.0, -2.0, -1.0), ("m", "d", "tiny", -50.0, 1.0, -1.0, 0.0),
                    ("m", "d", "good", 15.0, 30.0, 3.0, 1.0), ("m", "d", "flat", 3.0, 30.0, 1.0, 1.0),
                    ("cost", "d", "up", 30.0, None, 3.0, None)])
    cost = Measure("cost", "v", direction="lower_is_better", additivity="non_additive")
    got = {r["name"]: r["verdict"] for r in s.dimension_scan(rows, [M, cost]).collect()}
    assert got == {"bad": "unfavorable", "good": "favorable", "up": "unfavorable"}


def test_concentration_cases(make):
    m = Measure("m", "v", additivity="additive")
    schema = ("measure_id string, dimension string, name string, current double, baseline double,"
              "in_current boolean, in_base boolean")

    def row(pairs, total, **more):
        facts = make(schema, [("m", "who", n, v, None, True, False) for n, v in pairs]
                     + [("m", "(total)", "(total)", total, None, True, False)])
        return g.concentration(facts, more.pop("measure", m), "who").head()

    low = row([("known", 10.0), ("(空值)", 90.0)], 100.0)
    assert (low["status"], low["coverage_pct"], low["top5_share"], low["n50"]) == (
        "BLOCKED", 10.0, 10.0, None)
    assert row([("a", -1.0), ("b", 3.0)], 2.0)["reason_code"] == "negative_parts"
    assert row([("a", 0.0)], 0.0)["reason_code"] == "identified_total_not_positive"
    assert row([("a", 150.0)], 100.0)["reason_code"] == "coverage_above_100"
    skipped = row([("a", 1.0)], 1.0, measure=Measure("m", "v", "mean", additivity="non_additive"))
    assert skipped["status"] == "SKIPPED"
    ok = row([(str(i), 10.0) for i in range(10)], 100.0)
    assert (ok["status"], ok["top5_share"], ok["top10_share"], ok["n50"], ok["n80"]) == (
        "OK", 50.0, 100.0, 5, 8)


@pytest.mark.parametrize("kind", ["spread", "equal", "few_values", "one_giant"])
def test_members_to_reach_against_sorting(spark, kind):
    rng = random.Random(9)
    values = {"spread": [round(rng.paretovariate(1.2), 2) for _ in range(900)],
              "equal": [4.0] * 900, "few_values": [float(rng.choice([1, 2, 64])) for _ in range(900)],
              "one_giant": [1e6] + [1.0] * 900}[kind]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    got = g.members_to_reach(df, {"n50": 0.5, "n80": 0.8, "n99": 0.99}).head()
    for name, p in (("n50", 0.5), ("n80", 0.8), ("n99", 0.99)):
        cum, below = 0.0, 0
        for v in sorted(values, reverse=True):
            cum += v
            below += cum / sum(values) < p - 1e-12
        assert got[name] == below + 1, name


def test_median_matches_library(make):
    assert pystats.median(GOLDEN) == pytest.approx(
        series(make, GOLDEN).agg(F.median("value")).head()[0])
