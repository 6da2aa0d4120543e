"""Catalog queries against their SQL on the smallest tables.

All queries take minutes; by default a cross-section runs. Set CATALOG=all for every query and
CATALOG_DIR for other tables.
"""

import os

import pytest
from oracle_check import compare, connect

from measureloom.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("CATALOG_DIR", "/root/testdata/sf0.001")
SOME = (
    "a03_sqlite_scan", "a06_inline_sql", "a09_findings_sink", "b02_role_inference",
    "c01_number_coercion", "c06_period_labels", "d04_previous_calendar_period",
    "d07_partial_period", "e09_sum_by_day_ending", "e11_every_aggregation", "f02_one_sided_members",
    "f06_price_volume_mix", "g01_customer_rank", "g05_pareto_curve", "h01_mann_kendall_yoy",
    "h09_concentration", "i07_deduplicated_field_reference", "j06_duplicate_rows",
    "j18_member_drift", "k05_drift_unexpected",
)
CHOSEN = sorted(QUERIES) if os.environ.get("CATALOG") == "all" else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, con, name):
    problem = compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert problem in (None, "EMPTY")


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 5 and "contribution_pp" in df.columns


def test_result_diff_reads_one_run(spark, monkeypatch):
    """Facts that come out anew whenever they are computed are compared as one run left them."""
    from pyspark.sql import functions as F

    from measureloom.catalog import comparisons

    anew = F.udf(lambda: float(int.from_bytes(os.urandom(4), "big")), "double").asNondeterministic()
    run = spark.range(1).select(F.lit("revenue").alias("measure_id"), F.lit("(total)").alias("dimension"),
                                (anew() + 1).alias("current"), (anew() + 1).alias("baseline"))
    monkeypatch.setattr(comparisons, "facts", lambda *args: run)
    got = {(r["kind"], r["changes"]) for r in QUERIES["f12_result_diff"](spark, "").collect()}
    assert got == {("changed", 1), ("added", 1), ("removed", 1)}
