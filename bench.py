"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once cold and then BENCH_RUNS times (default 3); the median warm time is reported.
``python bench.py all`` times every registered query once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "a00_unhealthy_report", "a18_findings", "a20_diagnosis", "q01_profile_events", "q12_rule_set", "q15_schema_drift",
    "k05_upsert", "k06_hash_merge", "k07_merge_stats", "k10_high_water_mark",
    "m01_stg_trips", "m02_stg_orders", "m05_ecommerce_summary", "m06_revenue_by_category", "m07_customer_cohort",
    "m08_dim_customers", "m09_dim_taxi_zones", "m19_fact_orders",
    "f02_data_quality", "f08_cdc_lag", "l02_best_strategy", "l11_recall_unfiltered",
    "o04_sla_by_flow", "o05_daily_errors", "i03_top_categories", "c01_anti_patterns", "c04_total_savings",
    "w08_product_ranks", "w10_failure_streaks", "w15_cumulative_loaded", "n04_percentiles",
    "g05_blast_radius", "x04_isolation_forest", "z02_apply_changes_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from tidemill.plans.catalog import QUERIES
    from tidemill.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    everything = sys.argv[1:] == ["all"]
    names = list(QUERIES) if everything else sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        cold = once(name)
        times[name] = round(cold if everything else statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "sum of median warm query times", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
