import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from measureloom.functions import cleaning, display, labels
from measureloom.functions.special import two_sided_p
from measureloom.functions.sums import steady_sum


@pytest.mark.parametrize("text, value", [
    ("(1,234.5)", -1234.5), ("¥ 1", 1.0), ("¥1,000", 1000.0), ("￥2", 2.0), (" 3 ", 3.0),
    ("n/a", None), ("", None), (None, None), ("1e3", 1000.0), ("10d", None), ("nan", None),
    ("-5", -5.0), ("(-5)", None), (".5", 0.5),
])
def test_text_numbers(make, text, value):
    df = make("x string", [(text,)])
    assert df.select(cleaning.number(df, "x")).head()[0] == value


def test_nan_is_not_an_observation(make):
    df = make("x double", [(float("nan"),), (1.0,)])
    assert df.agg(F.count(cleaning.number(df, "x"))).head()[0] == 1


@pytest.mark.parametrize("text, value", [
    ("2025-12-01", dt.datetime(2025, 12, 1)), ("2025/1/2", dt.datetime(2025, 1, 2)),
    ("20250304", dt.datetime(2025, 3, 4)), ("2025年3月4日", dt.datetime(2025, 3, 4)),
    ("2025-01-01T00:00:00+08:00", dt.datetime(2025, 1, 1)),
    ("2025-01-02T20:00:00Z", dt.datetime(2025, 1, 3, 4)),
    ("2025-01-01 00:00:00+0900", dt.datetime(2024, 12, 31, 23)), ("bad-date", None), (None, None),
])
def test_timestamps(make, text, value):
    df = make("x string", [(text,)])
    got = df.select(cleaning.timestamp(df, "x", "Asia/Shanghai").cast("timestamp_ntz")).head()[0]
    assert got == value


def test_offset_detection(make):
    df = make("x string", [("2025-01-01",), ("2025-01-01T00:00:00Z",), ("2025-01-01T00:00+0800",)])
    assert [r[0] for r in df.select(cleaning.has_offset(df, "x")).collect()] == [False, True, True]


def test_direction_words(make):
    df = make("a double, b double", [(10.0, 12.0)])

    def state(before, after, direction):
        return df.select(labels.delta_state(F.lit(before), F.lit(after), F.lit(direction))).head()[0]

    assert state(10.0, 12.0, "higher_is_better") == "favorable"
    assert state(10.0, 12.0, "lower_is_better") == "unfavorable"
    assert state(12.0, 10.0, "lower_is_better") == "favorable"
    assert state(-10.0, -4.0, "neutral") == "neutral"
    assert state(1.0, 1.0, "higher_is_better") == "unchanged"
    favorable = df.select(*[labels.favorable(F.lit(x).cast("double"), F.lit(d)) for x, d in (
        (0.0, "lower_is_better"), (1.0, "neutral"), (None, "higher_is_better"),
        (-1.0, "lower_is_better"))]).head()
    assert tuple(favorable) == (True, None, None, True)


def test_labels(make):
    df = make("x string", [("极长的跨业务分类标签用于验证紧凑布局不会被单行挤坏",)])
    row = df.select(labels.truncated(F.col("x"), 12), labels.slug(F.lit(" A b/c! ")),
                    labels.slug(F.lit("销量"))).head()
    assert len(row[0]) == 12 and row[0].endswith("…")
    assert row[1:] == ("a_b_c", "measure")


@pytest.mark.parametrize("value, fmt, shown", [
    (1234567.0, "decimal", "1,234,567"), (12.5, "decimal", "12.5"), (0.35, "decimal", "0.3"),
    (0.25, "decimal", "0.3"), (-0.04, "decimal", "-0.0"), (12.5, "integer", "13"),
    (3.21, "signed_percent", "+3.2%"), (-3.21, "signed_percent", "-3.2%"),
    (1.04, "percentage_point", "1.0pp"), (7.0, "percent", "7.0%"),
])
def test_metric_format(make, value, fmt, shown):
    df = make("v double", [(value,)])
    assert df.select(display.format_metric(F.col("v"), F.lit(fmt))).head()[0] == shown


@pytest.mark.parametrize("value, shown", [
    (123456789.0, "1.2亿"), (12345678.0, "1,235万"), (1234567.0, "123.5万"), (12345.0, "1.2万"),
    (-12345.0, "-1.2万"), (999.5, "1,000"), (None, None),
])
def test_magnitude(make, value, shown):
    df = make("v double", [(value,)])
    assert df.select(display.format_magnitude(F.col("v"))).head()[0] == shown


@pytest.mark.parametrize("path, unit, fmt", [
    ("a.b.contribution_pp", "currency", "percentage_point"), ("a.change_pct", "count", "percent"),
    ("a.share", "currency", "percent"), ("a.current", "percent", "percent"),
    ("a.current", "person", "integer"), ("a.current", "currency", "decimal"),
])
def test_inferred_format(make, path, unit, fmt):
    df = make("p string", [(path,)])
    assert df.select(display.inferred_format(F.col("p"), F.lit(unit))).head()[0] == fmt


@pytest.mark.parametrize("text, wanted", [
    ("▲1,234.50万", (1234.5, "万", 2, 1)), ("▼ 3.2%", (-3.2, "%", 1, 1)),
    ("−12PP", (-12.0, "pp", 0, 1)), ("1,000 和 2", (1000.0, "", 0, 2)), ("abc", None),
])
def test_shown_numbers(make, text, wanted):
    df = make("t string", [(text,)])
    got = df.select(display.parse_shown(F.col("t"))).head()[0]
    assert (tuple(got) if got else None) == wanted


def test_p_value_is_exact_to_four_places(spark):
    df = spark.range(0, 700).select((F.col("id") / 100).alias("z"))
    worst = max(abs(r[1] - math.erfc(r[0] / math.sqrt(2)))
                for r in df.select("z", two_sided_p(F.col("z"))).collect())
    assert worst < 1e-6


@pytest.mark.parametrize("text, wanted", [
    ("5-Jan-2025", "2025-01-05 00:00:00"), ("01-12-2025", "2025-01-12 00:00:00"), ("12/31/25", "2025-12-31 00:00:00"),
    ("5 January 2025", "2025-01-05 00:00:00"), ("2025/1/5 10:00 PM", "2025-01-05 22:00:00"),
    ("31/12/2025", "2025-12-31 00:00:00"), ("\u3000Jan 5, 2025\u00a0", "2025-01-05 00:00:00"),
    ("2025-01-31T20:00:00Z", "2025-02-01 04:00:00"), ("2025-01-31 20:00:00 -0500", "2025-02-01 09:00:00"), ("soon", None)])
def test_mixed_time_forms(make, text, wanted):
    df = make("t string", [(text,)])
    got = df.select(cleaning.timestamp(df, "t", "Asia/Shanghai").cast("string")).head()[0]
    assert got == wanted


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_go_to_the_business_zone_and_filters_to_the_scan(spark, tmp_path, zone):
    from measureloom.operators.scope import within

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = [dt.datetime(2025, 1, 31, h, tzinfo=dt.timezone.utc) for h in (15, 16, 20)]
        spark.createDataFrame([(t,) for t in at], "t timestamp").write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
        days = df.select(F.to_date(cleaning.timestamp(df, "t", "Asia/Shanghai")).cast("string")).collect()
        assert sorted(r[0] for r in days) == ["2025-01-31", "2025-02-01", "2025-02-01"]
        month = df.where(within(df, "t", dt.date(2025, 2, 1), dt.date(2025, 2, 28), "Asia/Shanghai"))
        assert month.count() == 2
        assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t" in month._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unit_names_are_no_quantities(make):
    from measureloom.operators.profiling import column_profile, infer_measures, infer_roles

    df = make("unit_revenue double, business_unit string, units double", [(1.5, "a", 2.0), (2.5, "b", 3.0)])
    roles = {r["column"]: r["role"] for r in infer_roles(column_profile(df)).collect()}
    assert roles["unit_revenue"] == roles["units"] == "measure" and roles["business_unit"] != "measure"
    kinds = {r["field"]: r["semantic_type"] for r in infer_measures(infer_roles(column_profile(df))).collect()}
    assert kinds == {"unit_revenue": "amount", "units": "quantity"}


def test_times_in_any_form(spark):
    """Against the reader of mixed forms of a data frame library, which knows neither CJK days nor Q1 2025."""
    import pandas as pd

    from measureloom.functions import timeforms

    forms = """2025-01-05|2025-1-5 9:05|2025/1/5|2025/01/05 23:59:59|2025.1.5|20250105|202501051230|20250105123045|1/5/2025
13/5/2025|1/5/25|31/12/99|5-Jan-2025|5 Jan 2025|Jan 5, 2025|January 5 2025 3:04 PM|Sunday, 5 January 2025|Jan 2025|2025 Jan 5
2025-Jan-05|05-JAN-25|5th of January 2025|1/2025|2025/1|2025-01|2025|2025Q3|2025-01-05T10:00:00.123456|1/5/2025 12:00 AM
1/5/2025 12:30 pm|1/5/2025 13:30 pm|2025-02-30|n/a 5|hello|12.5|2025-13-01|day 5|1/5/2025 10 PM|2025-01-05 10:00:61|3.4.2021
31.12.2021|May 3, 2024|3 may 2024 10:05:06.5|2024-W05|99-01-31|Sept 4 2020|5/6|2025-1-5 9:5:3|Feb 30 2024|29 Feb 2024""".replace("\n", "|").split("|")
    df = spark.createDataFrame(list(enumerate(forms)), "i int, f string")
    got = dict(df.select("i", timeforms.moment(F.col("f")).cast("timestamp_ntz")).collect())

    def wanted(form):
        try:
            found = pd.to_datetime([form], format="mixed")[0]
        except (ValueError, OverflowError):
            return None
        return None if found is pd.NaT else found.to_pydatetime()

    assert {f: got[i] for i, f in enumerate(forms)} == {f: wanted(f) for f in forms}
    more = spark.createDataFrame([("2025年1月5日",), ("Q3 2025",), (None,), ("",)], "f string")
    assert [str(r[0]) for r in more.select(timeforms.moment(F.col("f"))).collect()] == [
        "2025-01-05 00:00:00", "2025-07-01 00:00:00", "None", "None"]


def test_offsets_of_any_form(spark):
    from measureloom.functions import timeforms

    cases = ["2025-01-05T20:00:00Z", "2025-01-05 20:00:00+0100", "5 Jan 2025 20:00 -05:00", "2025-01-05 20:00 +08:00", "01-12-2025"]
    df = spark.createDataFrame([(c,) for c in cases], "f string")
    assert [str(r[0]) for r in df.select(timeforms.moment(F.col("f"), "Asia/Shanghai")).collect()] == [
        "2025-01-06 04:00:00", "2025-01-06 03:00:00", "2025-01-06 09:00:00", "2025-01-05 20:00:00", "2025-01-12 00:00:00"]


def test_forms_that_are_not_read_are_counted(spark):
    from measureloom.functions import timeforms

    df = spark.createDataFrame([("2025-01-05",), ("day 5",), ("day 6",), (None,)], "f string")
    assert sorted(tuple(r) for r in timeforms.forms(df, "f").collect()) == [("9999-99-99", 1, 0), ("aaa 9", 2, 2)]


def test_exact_distinct_counts_of_awkward_columns(spark):
    from decimal import Decimal

    from measureloom.operators.profiling import column_profile

    rows = [(0.0, "a", Decimal("1.5"), True, None, "1,000"), (-0.0, "A", Decimal("1.5"), True, None, "n/a"),
            (float("nan"), "a ", Decimal("2"), False, None, "(3)"), (1.0, "", None, None, None, "¥ 7"), (1.0, None, None, None, None, "8")]
    df = spark.createDataFrame(rows, "v double, t string, d decimal(30,2), b boolean, n string, money string")
    got = {r["column"]: (r["rows"], r["null_pct"], r["distinct_count"], r["numeric"]) for r in column_profile(df).collect()}
    assert got == {"v": (5, 20.0, 2, True), "t": (5, 20.0, 4, False), "d": (5, 40.0, 2, True), "b": (5, 40.0, 2, False),
                   "n": (5, 100.0, 0, False), "money": (5, 0.0, 5, False)}
    assert column_profile(df.limit(0)).where("rows = 0 and distinct_count = 0").count() == 6


@pytest.mark.parametrize("value, shown", [(1.15e8, "1.1亿"), (-1.25e8, "-1.2亿"), (1.35e8, "1.4亿")])
def test_magnitude_shows_the_stored_double_from_a_hundred_million(make, value, shown):
    df = make("v double", [(value,)])
    assert df.select(display.format_magnitude(F.col("v"))).head()[0] == shown


PRICES = [2088.66, 2602.81, 2119.23, 1935.79, 261.26, 323.55, 2168.7]


def test_sums_of_equal_values_are_equal(make):
    df = make("k string, v double", [("a", v) for v in PRICES] + [("b", v) for v in sorted(PRICES)]).coalesce(1)
    got = {r["k"]: r for r in df.groupBy("k").agg(steady_sum(F.col("v")).alias("s"), F.sum("v").alias("p")).collect()}
    assert got["a"]["s"] == got["b"]["s"] == 11500.0 != got["a"]["p"]


@pytest.mark.parametrize("values, total", [
    ([None, None], None), ([], None), ([None, 2.5], 2.5), ([1e-300, 2e-300], 3e-300), ([1e300, -1e300, 1.0], 1.0),
    ([0.1 + 0.2], 0.1 + 0.2), ([-12345.678900000001], -12345.678900000001), ([float("inf"), 1.0], math.inf),
    ([2.0 ** 53, 0.25], 2.0 ** 53), ([0.00005, 0.49995], 0.5),
])
def test_steady_sums_of_any_size(make, values, total):
    got = make("v double", [(v,) for v in values]).agg(steady_sum(F.col("v"))).head()[0]
    assert got == (None if total is None else pytest.approx(total, rel=1e-15))


def test_magnitudes_of_exact_halves_in_any_order(spark, make, tmp_path):
    from measureloom.catalog import QUERIES

    rows = [(1, v) for v in PRICES] + [(2, v) for v in sorted(PRICES)]
    make("o_custkey bigint, o_totalprice double", rows).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_custkey"]: r["shown"] for r in QUERIES["c12_format_magnitude"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == "1.2万"
