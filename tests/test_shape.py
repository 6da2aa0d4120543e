import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from measureloom.contract import Measure, Scope
from measureloom.operators import aggregate as a
from measureloom.operators import shape as g
from measureloom.operators.ordering import ranked
from measureloom.operators.scope import resolve

ROWS = ("measure_id string, dimension string, name string, current double, baseline double, "
        "in_current boolean, in_base boolean")


def test_member_rank_order(make):
    df = make(ROWS, [("m", "d", "none", None, 5.0, True, True), ("m", "d", "b", 2.0, 1.0, True, True),
                     ("m", "d", "a", 2.0, 1.0, True, True), ("m", "d", "c", 9.0, None, True, False),
                     ("m", "d", "old2", None, 7.0, False, True),
                     ("m", "d", "old1", None, 8.0, False, True)])
    got = [r["name"] for r in g.rank_members(df).orderBy("rank").collect()]
    assert got == ["c", "a", "b", "none", "old1", "old2"]


@pytest.mark.parametrize("segments", [1, 5, 16])
def test_rank_and_running_total_of_hot_groups(spark, segments):
    rng = random.Random(segments)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), f"n{i:04d}",
             rng.choice([1.0, 1.0, 1.0, float(rng.randrange(50))])) for i in range(2500)]
    df = spark.createDataFrame(rows, "k string, name string, v double")
    got = ranked(df, ["k"], [F.col("v").desc(), F.col("name").asc()], running={"cum": "v"},
                 segments=segments).collect()
    by_name = {r["name"]: r for r in got}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        cum = 0.0
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        for place, (_, name, v) in enumerate(mine, 1):
            cum += v
            assert (by_name[name]["rank"], by_name[name]["cum"]) == (place, pytest.approx(cum))


def test_top_n_equals_full_rank(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xxxxy"), f"n{i}", float(rng.randrange(30))) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, name string, v double")
    order = [F.col("v").desc(), F.col("name").asc()]
    top = {(r["k"], r["name"], r["rank"]) for r in g.top_n(df, ["k"], order, 7).collect()}
    full = {(r["k"], r["name"], r["rank"]) for r in ranked(df, ["k"], order).where("rank <= 7").collect()}
    assert top == full


def test_extreme_member(make):
    def far(values):
        df = make("k string, name string, v double", [("k", f"n{i}", v) for i, v in enumerate(values)])
        return [r["name"] for r in g.extreme_split(df, ["k"], "v").where("extreme").collect()]

    assert far([5.0, -100.0, 4.0]) == ["n1"]
    assert far([5.0, -99.0, 4.0]) == []
    assert far([1.0, 0.0, 0.0]) == ["n0"]
    assert far([100.0, 1.0]) == []
    assert far([0.0, 0.0, 0.0]) == []


def test_waterfall(make):
    steps = make("step int, label string, value double", [
        (0, "base", 100.0), (1, "up", 30.0), (2, "down", -50.0), (3, "end", None)])
    got = [(r["base"], r["increase"], r["decrease"], r["total"]) for r in
           g.waterfall(steps).orderBy("step").collect()]
    assert got == [(0.0, None, None, 100.0), (100.0, 30.0, None, None), (80.0, None, 50.0, None),
                   (0.0, None, None, 80.0)]


@pytest.mark.parametrize("values, options, wanted", [
    ([0.0, 100.0], dict(bounded_percent=True), (0.0, 100.0)),
    ([10.0, 20.0], {}, (9.2, 20.8)), ([10.0, 20.0], dict(zero_baseline=True), (-1.6, 21.6)),
    ([5.0, 5.0], {}, (4.5, 5.5)), ([0.0], {}, (-0.1, 0.1)), ([None], {}, (0.0, 1.0))])
def test_value_domain(make, values, options, wanted):
    df = make("value double", [(v,) for v in values])
    assert tuple(g.value_domain(df, [], **options).head()) == pytest.approx(wanted)


def test_rank_table_drops_incomplete_rows(make):
    df = make("name string, a double, b double", [("x", 1.0, None), ("y", 2.0, 2.0), ("z", 3.0, 1.0)])
    assert [r["name"] for r in g.rank_table(df, ["a", "b"], 5).collect()] == ["z", "y"]


def test_slope_keeps_top_before_dropping_one_sided(make):
    df = make(ROWS, [("m", "d", f"n{i}", float(i), None if i == 9 else 1.0, True, i != 9)
                     for i in range(10)])
    got = g.slope_rows(df, [Measure("m", "v", direction="lower_is_better")]).collect()
    assert {r["name"] for r in got} == {f"n{i}" for i in range(2, 9)}
    assert {r["state"] for r in got} == {"unfavorable"}


def test_headlines_start_with_the_primary_measure(make):
    totals = make("measure_id string, current double, baseline double, change_abs double,"
                  "change_pct double", [("b", 1.0, None, None, None), ("a", 2.0, 1.0, 1.0, 100.0)])
    got = g.headline_candidates(totals, [Measure("b", "v"), Measure("a", "v", primary=True)])
    assert [r["path"] for r in got.orderBy("position").collect()] == [
        "measure_results.a.current", "measure_results.a.change_pct", "measure_results.a.baseline",
        "measure_results.a.change_abs", "measure_results.b.current"]


def test_heat_of_equal_cells(make):
    df = make("k string, value double", [("a", 3.0), ("b", 3.0)])
    assert {r["ratio"] for r in g.heat_table(df).collect()} == {0.5}


PRICES = [2088.66, 2602.81, 2119.23, 1935.79, 261.26, 323.55, 2168.7]


@pytest.fixture(scope="module")
def equal_customers(spark, tmp_path_factory):
    """Customers with the same order lines, each met in another order."""
    d = str(tmp_path_factory.mktemp("equal"))
    day = dt.datetime(2000, 3, 1)
    rng, keys = random.Random(3), range(11, 51)
    lines = [(k, v) for k in keys for v in rng.sample(PRICES, len(PRICES))]
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "INDIA", 0)]),
        "customer": ("c_custkey bigint, c_nationkey int, c_mktsegment string", [(k, 0, "X") for k in keys]),
        "part": ("p_partkey bigint, p_brand string, p_type string", [(1, "b", "t")]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate timestamp", [(k, k, day) for k in keys]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_returnflag string", [(k, 1, 1.0, v, 0.0, "N") for k, v in lines]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["g01_customer_rank", "g05_pareto_curve"])
def test_customers_of_equal_revenue_rank_by_name(spark, equal_customers, name):
    from measureloom.catalog import QUERIES

    got = QUERIES[name](spark, equal_customers).orderBy("rank").collect()
    assert [(r["name"], r["rank"]) for r in got] == [(str(k), i) for i, k in enumerate(range(11, 51), 1)]
    if name == "g05_pareto_curve":
        assert [(r["value"], r["cumulative_pct"]) for r in got] == [(11500.0, 2.5 * i) for i in range(1, 41)]


@pytest.mark.parametrize("how", ["sum", "mean", "weighted_mean"])
def test_equal_members_tie_in_every_sum(make, how):
    rows = [("a", v, 3.7) for v in PRICES] + [("b", v, 3.7) for v in sorted(PRICES)]
    m = Measure("m", "v", how, weight_field="w" if how == "weighted_mean" else None)
    df = make("k string, v double, w double", rows).coalesce(1)
    lock = resolve(df, Scope(mode="snapshot"), None)
    got = {r["name"]: r["current"] for r in a.member_facts(df, [m], ["k"], lock, None).collect()}
    assert got["a"] == got["b"]
