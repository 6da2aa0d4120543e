import datetime as dt

import pytest
from pyspark.sql import functions as F

from measureloom.contract import Scope
from measureloom.functions import calendar as cal
from measureloom.operators import scope as s

D = dt.date


@pytest.mark.parametrize("text, start, end, kind", [
    ("2023", "2023-01-01", "2023-12-31", "year"),
    ("2019 全年", "2019-01-01", "2019-12-31", "year"),
    ("2022h1", "2022-01-01", "2022-06-30", "half"),
    ("2021年上半年", "2021-01-01", "2021-06-30", "half"),
    ("2018-H2", "2018-07-01", "2018-12-31", "half"),
    ("2024Q1", "2024-01-01", "2024-03-31", "quarter"),
    ("2023年三季度", "2023-07-01", "2023-09-30", "quarter"),
    ("2026-Q2", "2026-04-01", "2026-06-30", "quarter"),
    ("2024-2", "2024-02-01", "2024-02-29", "month"),
    ("2023年7月", "2023-07-01", "2023-07-31", "month"),
    ("2024-02下旬", "2024-02-21", "2024-02-29", "xun"),
    ("2023-06-X1", "2023-06-01", "2023-06-10", "xun"),
    ("2022年9月2旬", "2022-09-11", "2022-09-20", "xun"),
    ("2024W1", "2024-01-01", "2024-01-07", "week"),
    ("2015-W53", "2015-12-28", "2016-01-03", "week"),
    ("2024-1-15至2024-03-02", "2024-01-15", "2024-03-02", "custom"),
    ("2022-11-30 .. 2023-01-04", "2022-11-30", "2023-01-04", "custom"),
])
def test_period_labels(spark, text, start, end, kind):
    p = spark.range(1).select(cal.period_bounds(F.lit(text)).alias("p")).head()["p"]
    assert (str(p["start"]), str(p["end"]), p["granularity"]) == (start, end, kind)


@pytest.mark.parametrize("text", ["2025-13", "2025-W54", "2021-W53", "hello", "2025-12-31..2025-01-01",
                                  "2025-02-30..2025-03-01", None])
def test_unreadable_labels(spark, text):
    assert spark.range(1).select(cal.period_bounds(F.lit(text).cast("string"))).head()[0] is None


@pytest.mark.parametrize("scope, wanted", [
    (Scope(period="2025-04", comparison="mom"), ("2025-03-01", "2025-03-31")),
    (Scope(period="2025-04", comparison="previous_equal_window"), ("2025-03-02", "2025-03-31")),
    (Scope(period="2025-W14", comparison="wow"), ("2025-03-24", "2025-03-30")),
    (Scope(period="2025Q1", comparison="qoq"), ("2024-10-01", "2024-12-31")),
    (Scope(period="2025H1", comparison="previous_complete_period"), ("2024-07-01", "2024-12-31")),
    (Scope(period="2025", comparison="previous_calendar_period"), ("2024-01-01", "2024-12-31")),
    (Scope(period="2025-02", comparison="yoy"), ("2024-02-01", "2024-02-28")),
    # No calendar rule for ten-day periods: equal length before it.
    (Scope(period="2025-12中旬", comparison="previous_calendar_period"),
     ("2025-12-01", "2025-12-10")),
    (Scope(period="2025-05", comparison="custom", baseline_period="2025-01"),
     ("2025-01-01", "2025-01-31")),
])
def test_baselines(spark, scope, wanted):
    row = s.lock_frame(spark, scope).head()
    assert (str(row["base_start"]), str(row["requested_base_end"])) == wanted


def test_alias_needs_its_granularity(spark):
    assert s.lock_frame(spark, Scope(period="2025Q1", comparison="mom")).head()["base_start"] is None


def test_partial_period_cuts_both_sides(spark):
    row = s.lock_frame(spark, Scope(
        period="2025-12", comparison="yoy", data_as_of="2025-12-15",
        comparison_as_of="2024-12-15")).head()
    assert (row["end"], row["base_end"]) == (D(2025, 12, 15), D(2024, 12, 15))
    assert row["completeness"] == "partial_same_cutoff" and row["like_for_like"]
    assert round(row["calendar_coverage_pct"], 1) == 48.4


def test_same_stage(spark):
    row = s.lock_frame(spark, Scope(
        period="2025-04", comparison="same_stage", data_as_of="2025-04-15",
        comparison_as_of="2025-03-15")).head()
    assert (row["base_start"], row["base_end"]) == (D(2025, 3, 1), D(2025, 3, 15))


def test_inferred_period(spark, make):
    days = make("d date", [(D(2025, 3, 4),), (D(2024, 1, 1),)])
    row = s.lock_frame(spark, Scope(period="填写, 如 2026H1"), s.last_day(days, "d")).head()
    assert row["inferred"] and (row["start"], row["requested_end"]) == (D(2025, 1, 1), D(2025, 3, 31))
    row = s.lock_frame(spark, Scope(granularity="xun"), s.last_day(days, "d")).head()
    assert row["requested_end"] == D(2025, 3, 10)


def test_overlapping_sides_keep_both(spark, make):
    days = make("d date, v int", [(D(2025, 1, 15), 1), (D(2025, 2, 15), 2), (D(2025, 3, 15), 3)])
    scope = Scope(period="2025-02-01..2025-03-31", comparison="custom",
                  baseline_period="2025-01-01..2025-02-28", data_as_of="2025-03-31")
    lock = s.resolve(days, scope, "d")
    rows = s.roles(s.tag(days, lock, "d")).groupBy("period_role").agg(F.sum("v").alias("v"))
    assert {r[0]: r[1] for r in rows.collect()} == {"current": 5, "base": 3}


def test_last_day_includes_its_hours(spark, make):
    stamps = make("t timestamp", [(dt.datetime(2025, 1, 31, 23, 59),), (dt.datetime(2025, 2, 1),)])
    assert stamps.where(s.within(stamps, "t", D(2025, 1, 1), D(2025, 1, 31))).count() == 1


def test_period_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select timestamp'2025-01-05 10:00:00' t, 1 v").write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(s.within(df, "t", D(2025, 1, 1), D(2025, 1, 31)))._jdf.queryExecution(
    ).executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThan(t" in plan


def test_period_keys(spark, make):
    days = make("d date", [(D(2024, 12, 30),)])
    got = days.select(*[cal.period_key(F.col("d"), f).alias(f) for f in cal.FREQUENCIES]).head()
    assert got.asDict() == {"period": "locked-period", "xun": "2024-12-X3", "week": "2025-W01",
                            "month": "2024-12", "quarter": "2024Q4", "half": "2024-H2",
                            "year": "2024"}


def test_plain_dates_agree_with_the_column_form(spark):
    from measureloom.functions import dates

    labels = [f"{y}{t}" for y in (2015, 2020, 2024, 2025) for t in (
        "", "Q1", "q4", "Q5", "Q0", "H1", "-H2", "H3", "W1", "W53", "-W54", "W0", "-2", "-12", "-13", "年7月", "年三季度", "-02下旬",
        "-06-X1", "-06X4", "年9月2旬", "全年", "上半年", "-1-15至2026-03-02", "-1-15~2010-03-02", "-02-30..2026-01-01", " Q 2", "x")]
    rows = spark.createDataFrame([(t,) for t in labels], "t string").select("t", cal.period_bounds(F.col("t")).alias("p"))
    for r in rows.collect():
        p = r["p"]
        assert dates.period(r["t"]) == (p and (p["start"], p["end"], p["granularity"], p["label"])), r["t"]
    kinds = ("yoy", "mom", "qoq", "wow", "previous_calendar_period", "previous_complete_period", "period_over_period",
             "previous_equal_window", "same_stage", "custom", "none")
    kinds = [k for k in kinds if k in cal.COMPARISONS]
    known = [p for t in labels if (p := dates.period(t))]
    custom = dates.period("2019Q2")
    df = spark.createDataFrame([p[:3] for p in known], "a date, b date, g string")
    struct = cal.period_bounds(F.lit("2019Q2"))
    got = df.select("a", "b", "g", *[cal.baseline_window(k, F.col("a"), F.col("b"), F.col("g"), struct).alias(k) for k in kinds])
    for r in got.collect():
        for k in kinds:
            assert dates.baseline(k, r["a"], r["b"], r["g"], custom) == (r[k] and tuple(r[k])), (r, k)


@pytest.mark.parametrize("scope", [
    Scope(period="2024H1", comparison="yoy", data_as_of="2024-02-29", comparison_as_of="2023-02-28"),
    Scope(period="2023-07", comparison="same_stage", data_as_of="2023-07-11", comparison_as_of="2023-06-11"),
    Scope(period="2023Q3", comparison="qoq", data_as_of="2023-12-31", comparison_as_of="2023-06-30"),
    Scope(period="2023", comparison="custom", baseline_period="2019-03-01..2019-04-02", data_as_of="2023-12-31"),
    Scope(period="2023-W05", comparison="mom", data_as_of="bad"),
])
def test_declared_locks_need_no_job(spark, scope):
    row = s.lock_frame(spark, scope).head()
    lock = s.declared_lock(scope)
    assert (lock.label, lock.granularity, lock.start, lock.end, lock.requested_end, lock.base_start, lock.base_end) == (
        row["label"], row["granularity"], row["start"], row["end"] or row["requested_end"], row["requested_end"],
        row["base_start"], row["base_end"])
