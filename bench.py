"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from measureloom.catalog import QUERIES  # noqa: E402
from measureloom.session import local_session  # noqa: E402

HEADLINES = (
    "a02_parquet_scan", "b01_column_profile", "c01_number_coercion", "c05_period_keys",
    "d07_partial_period", "e01_sum", "e03_median", "e06_distinct_count", "e09_sum_by_day_ending",
    "e11_all_measures_all_dimensions", "e11_every_aggregation", "e12_distribution",
    "e13_monthly_series", "f02_member_comparison", "f06_price_volume_mix", "f08_yoy_series",
    "g01_customer_rank", "g05_pareto_curve", "h01_mann_kendall_yoy", "h03_robust_z",
    "h09_concentration", "h13_problem_list", "i07_deduplicated_field_reference",
    "j04_blanks_per_period", "j06_duplicate_rows", "j18_member_overlap", "k02_content_fingerprint",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINES
    spark = local_session(cpus)
    QUERIES["e01_sum"](spark, sf_dir).collect()  # start the engine before timing
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus}))


if __name__ == "__main__":
    main()
