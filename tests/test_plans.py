"""Whole contracts on small business tables with known outcomes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from measureloom.contract import FieldSpec, Measure, Reference, Roles, SchemaContract, Scope
from measureloom.plans import Contract, build_report, derive_insights, draft, save_report

D = dt.date
# Worked out by hand: 2022 sells 960 in 24 pieces, 2023 1,200 in 30; the uplands rise by 30 % of
# what they had, the coast by 20 %.
GOLDEN = [
    (D(2022, 1, 11), "upland", "shop", "tea", "Ada", 120, 4, None),
    (D(2022, 2, 20), "upland", "post", "oats", "Ben", 280, 6, None),
    (D(2022, 4, 2), "coast", "shop", "tea", "Cleo", 200, 5, None),
    (D(2022, 6, 30), "coast", "post", "salt", "Dov", 360, 9, None),
    (D(2023, 1, 3), "upland", "shop", "tea", "Ada", 220, 7, 200.0),
    (D(2023, 3, 17), "upland", "post", "oats", "Ben", 300, 6, 400.0),
    (D(2023, 5, 9), "coast", "shop", "tea", "Cleo", 300, 7, 400.0),
    (D(2023, 6, 1), "coast", "post", "salt", "Dov", 380, 10, 500.0),
]
SCHEMA = ("date date, zone string, channel string, product string, customer string, amount int, "
          "qty int, target double")
AMOUNT = Measure("amount", "amount", "sum", "currency", "higher_is_better", "additive", "amount",
                 primary=True)
QTY = Measure("qty", "qty", "sum", "count", "higher_is_better", "additive", "quantity")
ROLES = Roles("date", ("zone", "channel"), "customer", "product", "target", amount="amount", qty="qty")
H1 = Scope(period="2023H1", comparison="yoy", data_as_of="2023-06-30", comparison_as_of="2022-06-30")


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    return build_report(df, Contract([AMOUNT, QTY], ROLES, H1, target_measure="amount",
                                     target_aggregation="sum"), fingerprint=True)


def test_golden_totals_and_target(golden):
    total = golden.totals.where("measure_id = 'amount'").head()
    assert (total["current"], total["baseline"], total["change_pct"]) == (1200.0, 960.0, pytest.approx(25))
    target = golden.references.where("id = 'legacy_target'").head()
    assert (target["status"], target["reference"], target["attainment_rate"]) == ("OK", 1500.0, pytest.approx(80))
    assert golden.status.head()["status"] == "OK"
    assert golden.pvm.head()["status"] == "OK"
    assert golden.concentration.head()["status"] == "OK"


def test_golden_members_add_up(golden):
    sums = golden.rows.where("measure_id = 'amount'").groupBy("dimension").agg(
        F.sum("share").alias("s"), F.sum("current").alias("c")).collect()
    assert len(sums) == 4 and all(r["s"] == pytest.approx(100) and r["c"] == 1200 for r in sums)


def test_saved_report(golden, spark, tmp_path):
    save_report(golden, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "totals")).count() == 2
    assert spark.read.parquet(str(tmp_path / "snapshot")).head()["rows"] == 8


def test_insights(golden):
    found = derive_insights(golden, top5_policy=(10, 20))
    movers = {r["name"]: r["verdict"] for r in found.scan.where("dimension = 'zone'").collect()}
    assert movers == {"upland": "favorable", "coast": "favorable"}
    assert found.quadrant.head()["quadrant"] == "量价齐升"
    assert {r["type"] for r in found.problems.collect()} == {"concentration_policy"}
    assert found.hhi.where("dimension = 'zone'").head()["hhi"] == pytest.approx((520 / 1200) ** 2 + (680 / 1200) ** 2)


def service(spark, **scope):
    rows = [(D(2025, 3, 2), "access", 50, 42), (D(2025, 3, 9), "events", 30, 85),
            (D(2025, 3, 16), "general", 80, 25), (D(2025, 4, 2), "access", 60, 36),
            (D(2025, 4, 9), "events", 28, 9999), (D(2025, 4, 16), "general", 95, 22)]
    df = spark.createDataFrame(rows, "date date, queue string, tickets int, resolution_minutes int")
    m = Measure("resolution", "resolution_minutes", "weighted_mean", "minute", "lower_is_better",
                "non_additive", "duration", weight_field="tickets", primary=True)
    return build_report(df, Contract(
        [m], Roles("date", ("queue",)), Scope(**scope),
        references=[Reference("goal", "target", "resolution", "minute", value=45.0)]))


def test_service_with_an_outlier(spark):
    report = service(spark, period="2025-04", comparison="previous_complete_period",
                     data_as_of="2025-04-30", comparison_as_of="2025-03-31")
    assert str(report.lock.base_start) == "2025-03-01"
    assert report.distribution.head()["max"] == 9999
    assert report.references.head()["status"] == "OK"
    methods = {r["method"]: r["status"] for r in report.methods.collect()}
    assert methods["pvm"] == methods["pareto"] == methods["mk_trend"] == "SKIPPED"
    assert all(r["share"] is None for r in report.rows.collect())


def test_snapshot_ignores_time(spark):
    report = service(spark, mode="snapshot")
    assert report.series is None and report.lock.mode == "snapshot"
    reasons = {r["reason_code"] for r in report.methods.where("method = 'mk_trend'").collect()}
    assert reasons == {"snapshot_has_no_time_series"}
    assert derive_insights(report).trend is None


def test_inventory_snapshot_with_negative_member(spark):
    rows = [(f"I{i:02d}", f"hub {i}", v) for i, v in enumerate(
        [120, 0, -5, 45, 210, 18, 76, 33, 5_000_000, 9, 12, 6, 88, 41, 37, 24, 19, 3])]
    df = spark.createDataFrame(rows, "record_id string, facility string, on_hand int")
    m = Measure("on_hand", "on_hand", "sum", "unit", "neutral", "semi_additive", "inventory",
                primary=True)
    report = build_report(df, Contract([m], Roles(dimensions=("facility",))))
    assert report.rows.count() == 18
    assert report.distribution.head()["min"] == -5
    assert report.methods.where("method = 'pareto'").head()["status"] == "SKIPPED"
    assert report.status.head()["status"] == "WARN"


def test_survey_with_custom_negative_baseline(spark):
    rows = [(D(2025, 1, 5), "new", -10), (D(2025, 1, 12), "returning", 20),
            (D(2025, 5, 5), "new", 5), (D(2025, 5, 12), "returning", 28)]
    df = spark.createDataFrame(rows, "date date, segment string, nps_score int")
    m = Measure("nps", "nps_score", "mean", "point", "higher_is_better", "non_additive", "score",
                primary=True, benchmark=30.0)
    report = build_report(df, Contract([m], Roles("date", ("segment",)), Scope(
        period="2025-05", comparison="custom", baseline_period="2025-01", data_as_of="2025-05-31",
        comparison_as_of="2025-01-31")))
    row = report.rows.where("name = 'new'").head()
    assert (row["baseline"], row["delta"], row["favorable"]) == (-10.0, 15.0, True)
    assert report.references.head()["favorable"] is False


def blocked(report):
    assert report.status.head()["status"] == "BLOCKED"
    assert all(r["current"] is None for r in report.totals.collect())
    with pytest.raises(ValueError, match="BLOCKED"):
        derive_insights(report)
    return {r["code"] for r in report.findings.where("severity = 'error'").collect()}


def test_blocked_runs_withhold_values(spark):
    df = spark.createDataFrame(GOLDEN + [GOLDEN[4]] * 3, SCHEMA)
    assert blocked(build_report(df, Contract([AMOUNT], ROLES, H1))) == {"duplicate_rows"}
    late = Scope(period="2031Q1", data_as_of="2031-03-31")
    assert blocked(build_report(df, Contract([AMOUNT], Roles("date"), late))) >= {
        "empty_current_period"}
    open_period = Scope(period="填写, 如 2026H1", data_as_of="2025-12-31")
    assert "period_inferred" in blocked(build_report(df, Contract([AMOUNT], Roles("date"), open_period)))


def test_member_drift_blocks_but_keeps_values(spark):
    rows = [(D(2025, 1, 1), f"new{i}", 1.0 + i) for i in range(3)]
    rows += [(D(2024, 1, 1), f"old{i}", 1.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "d date, zone string, v double")
    report = build_report(df, Contract([Measure("v", "v", primary=True)], Roles("d", ("zone",)), Scope(
        period="2025-01", comparison="yoy", data_as_of="2025-01-31", comparison_as_of="2024-01-31")))
    assert report.status.head()["status"] == "BLOCKED"
    assert report.totals.head()["current"] == 6.0


def test_schema_and_drift_findings_reach_the_status(spark, golden):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    schema = SchemaContract("one row per sale", ("zone",), {
        "amount": FieldSpec(True, "number", "currency", "sum"), "branch": FieldSpec(True)})
    codes = blocked(build_report(df, Contract([AMOUNT], ROLES, H1, schema)))
    assert codes == {"primary_key_repeated", "declared_field_missing"}
    grown = spark.createDataFrame(GOLDEN * 2, SCHEMA).withColumn("qty", F.monotonically_increasing_id())
    report = build_report(grown, Contract([AMOUNT, QTY], ROLES, H1), baseline=golden.snapshot,
                          expected_change=True)
    assert {r["state"] for r in report.drift.where("check_name = 'row_count'").collect()} == {"BLOCKED"}
    assert report.status.head()["status"] == "BLOCKED"


def test_draft(spark):
    df = spark.createDataFrame([(D(2025, 12, i + 1), f"z{i % 3}", f"客户{i}", 10 * i)
                                for i in range(20)], "`日期` date, `区域` string, `客户` string, `销量` int")
    found = draft(df)
    roles, measures = found.to_roles(), found.to_measures()
    assert (roles.time, roles.dimensions, roles.customer) == ("日期", ("区域",), "客户")
    assert [(m.field, m.semantic_type, m.primary) for m in measures] == [("销量", "quantity", True)]
    assert {r["analysis"] for r in found.suggestions.collect()} == {
        "single_year", "region_ranking", "customer_pareto"}
    assert draft(df, approximate=True).to_roles() == roles


def test_input_written_once_is_read_by_columns_and_quantiles_only_on_demand(spark, monkeypatch):
    from measureloom.operators import aggregate
    from measureloom.session import written_table

    made, real = [], aggregate.distribution
    monkeypatch.setattr(aggregate, "distribution", lambda *args: made.append(args) or real(*args))
    rows = [(D(y, m, d), "a b", float(d), None, -0.0) for y in (2024, 2025) for m in (1, 2) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "date date, `q u.e;ue` string, v double, empty string, zero double")
    contract = Contract([Measure("v", "v", "sum", primary=True)], Roles("date", ("q u.e;ue",)), Scope(
        period="2025Q1", comparison="yoy", data_as_of="2025-03-31", comparison_as_of="2024-03-31"))
    report = build_report(df, contract, write_once=True)
    derive_insights(report).problems.collect()
    assert made == []
    assert report.distribution.head()["max"] == 3.0 and report.distribution is report.distribution and len(made) == 1
    assert {r["current"] for r in report.totals.collect()} == {12.0}
    copy = written_table(df)
    assert copy.schema == df.schema and sorted(map(str, copy.collect())) == sorted(map(str, df.collect()))
    assert "FileScan parquet" in copy._jdf.queryExecution().toString()
    odd = written_table(df.selectExpr("array(v) AS list", "null AS nothing"))
    assert odd.count() == 12 and "FileScan" not in odd._jdf.queryExecution().toString()
