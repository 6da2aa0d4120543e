import datetime as dt

import pytest

from measureloom.contract import Measure, Reference, Roles, Scope
from measureloom.operators import references as ref
from measureloom.operators import scope as s

M = Measure("duration", "v", "mean", "minute", "lower_is_better", "non_additive", primary=True)
SNAPSHOT = Scope(mode="snapshot")
D = dt.date


def evaluate(make, refs, current=45.0, fields=None, measure=M):
    totals = make("measure_id string, current double", [(measure.id, current)])
    return {r["id"]: r for r in ref.evaluate_references(refs, totals, [measure], fields).collect()}


def test_lower_is_better_target_and_band(make):
    got = evaluate(make, [
        Reference("target", "target", "duration", "minute", value=40),
        Reference("band", "benchmark", "duration", "minute", lower=35, upper=50),
        Reference("off", "benchmark", "duration", "minute", lower=50, upper=60)])
    assert round(got["target"]["attainment_rate"], 1) == 88.9
    assert got["target"]["favorable"] is False and got["target"]["delta"] == 5
    assert got["band"]["favorable"] is True and got["band"]["delta"] == 0
    assert got["off"]["favorable"] is False and got["off"]["delta"] == 5


@pytest.mark.parametrize("more, current, reason", [
    (dict(value=1, unit="hour"), 45.0, "reference_unit_mismatch"),
    (dict(value=1, unit=None), 45.0, "reference_unit_missing"),
    (dict(value=1, measure="x"), 45.0, "unknown_measure"),
    (dict(value=1), None, "measure_current_unavailable"),
    (dict(lower=5, upper=1), 45.0, "reference_contract_invalid"),
    (dict(value=1, direction_rule="upwards"), 45.0, "reference_contract_invalid"),
    (dict(), 45.0, "reference_missing"),
])
def test_reasons(make, more, current, reason):
    spec = {"id": "r", "type": "target", "measure": "duration", "unit": "minute", **more}
    row = evaluate(make, [Reference(**spec)], current)["r"]
    assert (row["status"], row["reason_code"], row["favorable"]) == ("SKIPPED", reason, None)


def test_group_reference(make):
    facts = make("measure_id string, dimension string, name string, current double", [
        ("duration", "queue", "A", 30.0), ("duration", "queue", "B", 60.0),
        ("duration", "(total)", "(total)", 45.0)])
    refs = [Reference("a", "group", "duration", "minute", dimension="queue", reference_group="A"),
            Reference("all", "group", "duration", "minute", dimension="queue")]
    got = {(r["id"], r["name"]): (r["delta"], r["favorable"], r["reference_group"])
           for r in ref.group_references(refs, facts, [M]).collect()}
    assert got[("a", "B")] == (30.0, False, "A")
    assert got[("all", "A")] == (-15.0, True, "overall")


def resolve(make, rows, *refs, period=None):
    df = make("d date, zone string, plan string", rows)
    scope = Scope(period=period, data_as_of="2025-12-31") if period else SNAPSHOT
    lock = s.resolve(df, scope, "d")
    return {r["id"]: r for r in ref.field_references(df, refs, lock, "d").collect()}


def spec(name, how, **more):
    return Reference(name, "target", "duration", "minute", field="plan", aggregation=how, **more)


def test_repeated_values(make):
    rows = [(D(2025, 12, 1), "n", "500"), (D(2025, 12, 2), "s", "500")]
    got = resolve(make, rows, spec("auto", "auto"), spec("unique", "unique"), spec("sum", "sum"))
    assert got["auto"]["reason_code"].startswith("reference_field_requires_single")
    assert got["unique"]["field_value"] == 500.0 and got["sum"]["field_value"] == 1000.0


def test_quarter_plan_counts_once_per_zone(make):
    rows = [(D(2025, 10, 1), "n", "300"), (D(2025, 11, 1), "n", "300"),
            (D(2025, 10, 2), "s", "300"), (D(2025, 12, 2), "s", "300")]
    got = resolve(make, rows, spec("p", "first_per_group", grain=("zone",), frequency="quarter"),
                  spec("month", "first_per_group", grain=("zone",), frequency="month"),
                  spec("all", "unique_per_period", frequency="quarter"), period="2025Q4")
    assert got["p"]["field_value"] == 600.0
    assert got["month"]["field_value"] == 1200.0
    assert got["all"]["field_value"] == 300.0


def test_conflict_gap_and_bad_declarations(make):
    rows = [(D(2025, 10, 1), "n", "300"), (D(2025, 10, 2), "n", "310"), (D(2025, 10, 1), "s", None)]
    got = resolve(make, rows, spec("gap", "first_per_group", grain=("zone",)),
                  spec("torn", "first_per_group"), spec("grain", "first_per_group", grain=("x",)),
                  spec("freq", "first_per_group", frequency="fortnight"), spec("how", "mode"))
    assert {k: v["reason_code"] for k, v in got.items()} == {
        "gap": "reference_grain_incomplete", "torn": "reference_grain_conflict",
        "grain": "reference_grain_missing", "freq": "reference_frequency_invalid",
        "how": "reference_aggregation_invalid"}


def test_parse_errors_above_the_limit_block(make):
    rows = [(D(2025, 12, 1), "n", "bad"), (D(2025, 12, 2), "s", "100")]
    df = make("d date, zone string, plan string", rows)
    lock = s.resolve(df, SNAPSHOT, None)
    for limit, status in ((5.0, "BLOCKED"), (60.0, "OK")):
        r = spec("t", "sum", required=True, parse_block_pct=limit)
        row = evaluate(make, [r], fields=ref.field_references(df, [r], lock, None))["t"]
        assert row["status"] == status


def test_gathering_and_role_target():
    amount = Measure("amount", "amount", unit="currency", benchmark=5.0, target_field="goal")
    refs = ref.gather_references([], [Reference("x y", "target", "amount", value=1.0)], [amount],
                                 Roles(target="plan", amount="amount"), "amount")
    assert [(r.id, r.source) for r in refs] == [
        ("x_y", "references"), ("target_amount", "measure"), ("benchmark_amount", "measure"),
        ("legacy_target", "legacy")]
    missing = ref.gather_references([], [], [amount], Roles(target="plan"))[-1]
    assert missing.invalid_reason == "legacy_target_measure_missing"
    clash = ref.gather_references([], [], [amount], Roles(target="目标销量", amount="amount"), "amount")
    assert clash[-1].invalid_reason == "legacy_target_unit_conflict"
