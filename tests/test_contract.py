import pytest

from measureloom.contract import ContractError, Measure, Scope, ascii_id, check_measures


def test_usable_measure_has_no_problems():
    m = Measure("revenue", "amount", unit="currency")
    assert m.problems(["amount"], True) == []


@pytest.mark.parametrize("change, word", [
    (dict(aggregation="mode"), "aggregation"), (dict(unit=" "), "unit"),
    (dict(direction="up"), "direction"), (dict(additivity="some"), "additivity"),
    (dict(semantic_type="thing"), "semantic_type"), (dict(field="gone"), "column gone"),
    (dict(field=None), "field missing"), (dict(aggregation="weighted_mean"), "weight_field"),
    (dict(aggregation="ratio", field=None), "numerator"),
    (dict(numerator_field="amount"), "ratio only"), (dict(min_weight_coverage_pct=101), "0..100"),
    (dict(additivity="semi_additive"), "time_aggregation"),
    (dict(semantic_type="rate", unit="percent"), "storage_scale"),
    (dict(time_aggregation="first"), "time_aggregation"), (dict(unit_field="u"), "unit column"),
])
def test_each_rule_is_enforced(change, word):
    values = {"id": "m", "field": "amount", "unit": "currency", **change}
    assert any(word in p for p in Measure(**values).problems(["amount"], True))


def test_required_problem_is_error_optional_is_warning():
    good = Measure("a", "x", primary=True)
    kept, found = check_measures(
        [good, Measure("b", "gone"), Measure("c", "gone", required=False), Measure("a", "x")],
        ["x"], False)
    assert [m.id for m in kept] == ["a"]
    assert [f[0] for f in found] == ["error", "warning", "error"]


def test_exactly_one_primary():
    kept, found = check_measures([Measure("a", "x"), Measure("b", "x")], ["x"], False)
    assert [m.primary for m in kept] == [True, False]
    assert ("error", "primary_measure_count", "0") in found
    kept, _ = check_measures([Measure("a", "x", primary=True), Measure("b", "x", primary=True)],
                             ["x"], False)
    assert [m.primary for m in kept] == [True, False]


def test_scope_rejects_unknown_words():
    with pytest.raises(ContractError):
        Scope(comparison="last_time")
    with pytest.raises(ContractError):
        Scope(mode="live")
    assert Scope(comparison="target").comparison_type == "none"


def test_ascii_id():
    assert ascii_id("Order Lines!") == "order_lines"
    assert ascii_id("销量") == "measure"
