"""Scans, shuffles and broadcasts of the executed plans of queries: python tools/plans.py [--sf DIR] name ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

FLAGSHIP = ["a00_unhealthy_report", "q01_profile_events", "k06_hash_merge", "m07_customer_cohort", "l11_recall_unfiltered",
            "m08_dim_customers", "m09_dim_taxi_zones", "o04_sla_by_flow", "w10_failure_streaks"]


def nodes(plan, seen: set, identity):
    """Operators that ran, each once: through adaptive wrappers and stages, and into subqueries; reused ones are left out."""
    name = plan.nodeName()
    if name.startswith("Reused") or identity(plan) in seen:
        return
    seen.add(identity(plan))
    if name == "AdaptiveSparkPlan":
        yield from nodes(plan.executedPlan(), seen, identity)
        return
    if name.endswith("QueryStage"):
        yield from nodes(plan.plan(), seen, identity)
        return
    yield name, plan.toString().split("\n", 1)[0]
    subqueries = plan.subqueries()
    for i in range(subqueries.size()):
        yield from nodes(subqueries.apply(i), seen, identity)
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i), seen, identity)


def counts(plan, identity) -> dict[str, int]:
    found = list(nodes(plan, set(), identity))
    shuffles = [line for name, line in found if name == "Exchange"]
    return {
        "scans": sum(name.startswith("Scan ") for name, _ in found),
        "shuffles": sum("SinglePartition" not in line for line in shuffles),
        "single": sum("SinglePartition" in line for line in shuffles),
        "broadcasts": sum(name == "BroadcastExchange" for name, _ in found),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--show", action="store_true", help="print the plans too")
    ap.add_argument("names", nargs="*", default=FLAGSHIP)
    args = ap.parse_args()
    from tidemill.plans.catalog import QUERIES
    from tidemill.session import build_session

    spark = build_session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.names:
        df = QUERIES[name](spark, args.sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        print(name, counts(plan, spark._jvm.System.identityHashCode), flush=True)
        if args.show:
            print(plan.toString())
    spark.stop()


if __name__ == "__main__":
    main()
