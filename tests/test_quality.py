import datetime as dt

import pytest
from pyspark.sql import functions as F

from measureloom.contract import FieldSpec, Measure, Roles, SchemaContract, Scope, Thresholds
from measureloom.operators import lineage as k
from measureloom.operators import quality as q
from measureloom.operators import reconcile as r
from measureloom.operators import scope as s

D = dt.date
V = Measure("v", "v", semantic_type="amount", primary=True)
YOY = Scope(period="2025-12", comparison="yoy", data_as_of="2025-12-31",
            comparison_as_of="2024-12-31")


def codes(findings):
    return {(f["severity"], f["code"]) for f in findings.collect()}


def counted(df, scope=YOY):
    return q.scope_counts(df, V, s.resolve(df, scope, "d"), "d")


def test_blanks_of_one_period_are_not_diluted(make):
    rows = [(D(2025, 12, 1), None if i < 9 else "100") for i in range(10)]
    rows += [(D(2024, 12, 1), "100")] * 200
    counts = counted(make("d date, v string", rows))
    side = {x["side"]: x for x in q.measure_quality(counts).collect()}
    assert side["scope"]["blank_pct"] < 5 and side["current"]["blank_pct"] == 90.0
    assert ("error", "measure_blank") in codes(q.measure_gates(counts, V))


def test_parse_errors_and_negatives(make):
    counts = counted(make("d date, v string", [(D(2025, 12, 1), x) for x in ("1", "x", "-5")]))
    assert codes(q.measure_gates(counts, V)) == {
        ("error", "measure_parse_errors"), ("warning", "negative_values")}
    assert ("error", "negative_values") in codes(
        q.measure_gates(counts, V, Thresholds(negative_policy="block")))


def test_empty_period(make):
    counts = counted(make("d date, v string", [(D(2020, 1, 1), "1")]))
    assert codes(q.empty_current(counts)) == {("error", "empty_current_period")}


def test_duplicates_are_not_diluted(make):
    rows = [(D(2025, 12, 1), "c", 100.0)] * 2 + [(D(2024, 12, 1), f"b{i}", 100.0) for i in range(200)]
    df = make("d date, who string, v double", rows)
    dup = q.duplicate_rows(df, V, s.resolve(df, YOY, "d"), "d")
    side = {x["side"]: x for x in dup.collect()}
    assert side["scope"]["row_pct"] < 5 and side["current"]["row_pct"] == 50.0
    assert codes(q.duplicate_gate(dup)) == {("error", "duplicate_rows")}


def test_immaterial_duplicates_only_warn(make):
    rows = [(D(2025, 12, 1 + i), f"c{i}", 1000.0) for i in range(21)] + [(D(2025, 12, 22), "t", 1.0)] * 2
    df = make("d date, who string, v double", rows)
    dup = q.duplicate_rows(df, V, s.resolve(df, YOY, "d"), "d")
    assert codes(q.duplicate_gate(dup)) == {("warning", "duplicate_rows")}


def test_row_digest_tells_rows_apart(make):
    df = make("a string, b string, x double, t timestamp", [
        ("1", None, 0.0, None), (None, "1", 0.0, None), ("1", "", 0.0, None), ("a|b", "c", 0.0, None),
        ("a", "b|c", 0.0, None), ("t", None, 0.0, dt.datetime(2025, 1, 1, 0, 0, 0, 1)),
        ("t", None, 0.0, dt.datetime(2025, 1, 1, 0, 0, 0, 2)), ("1", None, -0.0, None)])
    assert df.select(q.row_digest(df)).distinct().count() == 7


def test_repeated_ids(make):
    df = make("id string, v int", [("a", 1), ("a", 2), ("b", 1), ("b", 1)])
    assert codes(q.repeated_ids(df, "id")) == {("warning", "repeated_ids")}
    assert codes(q.repeated_ids(df.where("id = 'b'"), "id")) == set()


def test_observations(make):
    df = make("d date, v string", [(D(2024, 12, 1), "1"), (D(2025, 12, 1), "1")])
    found = q.observation_gate(counted(df), 10, 1, "distinct_dates").collect()
    assert [(f["subject"], f["value"]) for f in found] == [("current", 10.0)]
    with pytest.raises(ValueError):
        q.observation_gate(counted(df), 0, 1)


def test_time_gates(make):
    df = make("d string", [("bad",), ("2025-12-01",)])
    assert codes(q.time_gates(df, "d")) == {("error", "time_parse_failures")}
    df = make("d string", [("2025-01-01T00:00:00+08:00",)])
    assert codes(q.time_gates(df, "d")) == {("error", "offset_without_timezone")}
    assert codes(q.time_gates(df, "d", "Asia/Shanghai")) == set()


@pytest.mark.parametrize("change, code", [
    (dict(data_as_of=None), "data_as_of_missing"), (dict(data_as_of="2025/12/31"), "data_as_of_missing"),
    (dict(comparison_as_of="2024-12-01"), "baseline_not_covered"),
    (dict(comparison_as_of=None), "comparison_as_of_missing"),
    (dict(data_as_of="2025-11-01"), "data_as_of_before_start")])
def test_cutoffs(spark, change, code):
    values = dict(period="2025-12", comparison="yoy", data_as_of="2025-12-31",
                  comparison_as_of="2024-12-31")
    assert codes(q.cutoff_gate(s.lock_frame(spark, Scope(**values)))) == set()
    assert ("error", code) in codes(q.cutoff_gate(s.lock_frame(spark, Scope(**{**values, **change}))))


def test_weight_coverage(make):
    df = make("score int, weight int", [(80, 10), (100, None)])
    m = Measure("s", "score", "weighted_mean", weight_field="weight", primary=True,
                additivity="non_additive")
    quality = q.axis_quality(df, [m], s.resolve(df, Scope(mode="snapshot"), None), None)
    row = quality.head()
    assert (row["coverage_pct"], row["status"]) == (50.0, "BLOCKED")
    assert codes(q.axis_gate(quality, [m])) == {("error", "weight_coverage_below_threshold")}


def test_declared_schema(make):
    df = make("id string, value int, unit string", [("A", 10, "minute"), ("A", 20, "minute")])
    m = Measure("duration", "value", "mean", "minute", unit_field="unit", primary=True)
    contract = SchemaContract("one row per id", ("id",), {
        "id": FieldSpec(True, "string"), "value": FieldSpec(True, "number", "minute"),
        "note": FieldSpec(False, "string"), "must": FieldSpec(True)})
    assert codes(q.missing_fields(df, contract)) == {
        ("warning", "declared_field_missing"), ("error", "declared_field_missing")}
    assert [f["value"] for f in q.key_duplicates(df, contract).collect()] == [2.0]
    assert codes(q.observed_units(df, [m])) == set()
    assert codes(q.observed_units(df.withColumn("unit", F.lit("hour")), [m])) == {("error", "unit_drift")}
    assert q.contract_conflicts(df.sparkSession, contract, [m]).count() == 0
    drifted = SchemaContract(None, None, {"value": FieldSpec(True, "number", "hour", "sum")})
    assert {c for _, c in codes(q.contract_conflicts(
        df.sparkSession, drifted, [m], Roles(amount="x", qty="x")))} == {
        "business_grain_missing", "primary_key_undeclared", "declared_unit_differs",
        "declared_aggregation_differs", "amount_and_quantity_same_column"}


def test_status_and_suppression(make, spark):
    blocked = q.status(q.findings(spark, [("error", "x", "y", None, None)]))
    warned = q.status(q.findings(spark, [("warning", "x", "y", None, None)]))
    fine = q.status(q.no_findings(spark))
    assert [x.head()["status"] for x in (blocked, warned, fine)] == ["BLOCKED", "WARN", "OK"]
    df = make("a double", [(1.0,)])
    assert q.suppress_when_blocked(df, blocked, ["a"]).head()["a"] is None
    assert q.suppress_when_blocked(df, warned, ["a"]).head()["a"] == 1.0


def snap(make, rows, direction="higher_is_better", schema="id string, value int"):
    m = Measure("score", "value", "mean", "point", direction, "non_additive", primary=True)
    return k.snapshot(make(schema, rows), [m], SchemaContract("one row per id", ("id",), {}))


def test_drift(make):
    base = snap(make, [("A", 10), ("B", 20)])

    def verdict(now, **policy):
        found = k.drift(now, base, **policy)
        return k.drift_status(found).head()["status"], {
            x["check_name"]: x["state"] for x in found.collect()}

    assert verdict(snap(make, [("B", 20), ("A", 10)]), expected_change=False)[0] == "OK"
    changed = snap(make, [("A", 11), ("B", 20)])
    assert verdict(changed, expected_change=False)[0] == "BLOCKED"
    assert verdict(changed, expected_change=True)[0] == "OK"
    assert verdict(changed)[0] == "WARN"
    assert verdict(base, expected_change=True)[0] == "WARN"
    status, checks = verdict(snap(make, [("A", 11), ("B", 20), ("C", 30)]), expected_change=True)
    assert (status, checks["row_count"]) == ("BLOCKED", "BLOCKED")
    noted = snap(make, [("A", 10, "x"), ("B", 20, "y")], schema="id string, value int, note string")
    assert verdict(noted, expected_change=True) == ("BLOCKED", {
        "schema": "CHANGED", "semantic_contract": "UNCHANGED", "result_snapshot": "CHANGED",
        "row_count": "OK"})
    assert verdict(noted, expected_change=True, allow_schema=True)[0] == "WARN"
    turned = snap(make, [("A", 10), ("B", 20)], "lower_is_better")
    assert verdict(turned, expected_change=False)[1]["semantic_contract"] == "CHANGED"


def test_row_count_edges(make):
    def one(base, now):
        frame = lambda n: make("rows bigint", [(n,)])
        return k.row_count_drift(frame(now), frame(base)).head()["status"]

    assert [one(0, 0), one(0, 5), one(100, 109), one(100, 111), one(100, 131), one(100, 69)] == [
        "UNCHANGED", "BLOCKED", "OK", "WARN", "BLOCKED", "BLOCKED"]


def test_flatten_every_leaf(spark):
    df = spark.sql("select struct(1 as a, array(2.5D, null) as b) as s, map('k', named_struct('x', 3))"
                   " as m, 'text' as t, true as flag")
    assert {(x["path"], x["value"]) for x in r.flatten(df).collect()} == {
        ("s.a", 1.0), ("s.b.0", 2.5), ("s.b.1", None), ("m.k.x", 3.0)}


def test_shown_in_larger_unit(make):
    claims = make("path string, text string", [("a.total_wan", "1.2亿"), ("a.total_wan", "1.3亿")])
    metrics = make("path string, value double", [("a.total_wan", 12345.0)])
    assert [x["outcome"] for x in r.shown_numbers(claims, metrics).orderBy("text").collect()] == [
        "match", "mismatch"]


def test_chart_null_matches_only_null(make):
    metrics = make("path string, value double", [("p", None), ("q", 1.0)])
    points = make("path string, transform string, factor double, tolerance double, actual double", [
        ("p", None, None, None, None), ("p", None, None, None, 0.0), ("q", "negate", 2.0, 0.1, -2.05),
        ("gone", None, None, None, None)])
    assert [x["matched"] for x in r.chart_values(points, metrics).orderBy(
        "path", F.col("actual").asc_nulls_first()).collect()] == [False, True, False, True]


def test_coverage_of_nothing(make):
    claims = make("bound boolean, exempt boolean", [])
    assert r.number_coverage(claims).head()["coverage_pct"] == 100.0
