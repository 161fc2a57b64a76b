"""Observability measures over runs, incidents and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.constants import DEFAULT_SLA_SECONDS, SLA_SECONDS
from tidemill.functions.exprs import back, dbl, decode, ratio_sum, rnd, seconds_between, share_pct
from tidemill.functions.ordered import exact_percentiles
from tidemill.operators.anomalies import LATEST, newest_runs

SLA_LIMIT_SECONDS = 300


def _ok() -> Column:
    return F.col("status") == "success"


def records_loaded(runs: DataFrame) -> DataFrame:
    return runs.filter(_ok()).agg(F.coalesce(F.sum("records_loaded"), F.lit(0)).alias("total_records_loaded"))


def daily_records(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Records loaded per day and flow, with a 'Mon DD' label."""
    recent = runs.filter(F.col("started_at") >= back(as_of, f"{days} days"))
    return recent.groupBy(F.to_date("started_at").alias("day"), "pipeline_name").agg(
        F.sum("records_loaded").alias("records")).withColumn("date", F.date_format("day", "MMM dd"))


def daily_incidents(incidents: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = incidents.filter(F.col("detection_at") >= back(as_of, f"{days} days"))
    return recent.groupBy(F.to_date("detection_at").alias("day")).agg(F.count("*").alias("incidents")).withColumn(
        "date", F.date_format("day", "MMM dd"))


def sla_by_flow(runs: DataFrame, as_of: Column, days: int = 30, top: int | None = None, approx: bool = False) -> DataFrame:
    """Runs, p50/p95 duration, success %, breaches and last run per flow; with ``top``, the slowest by p95.

    ``approx`` takes the percentiles from a sketch in the same pass; the exact form needs two passes.
    """
    recent = runs.filter((F.col("started_at") >= back(as_of, f"{days} days")) & F.col("duration_seconds").isNotNull())
    aggs = [
        F.count("*").alias("total_runs"), share_pct(_ok()).alias("success_rate"),
        F.count_if(F.col("duration_seconds") > SLA_LIMIT_SECONDS).alias("sla_breaches"),
        F.max("started_at").alias("last_run_at"),
    ]
    if approx:
        sketch = F.percentile_approx(dbl(F.col("duration_seconds")), [0.5, 0.95], 10_000)
        table = recent.groupBy("pipeline_name").agg(*aggs, sketch.alias("_p")).withColumns(
            {"p50_s": rnd(F.col("_p")[0], 1), "p95_s": rnd(F.col("_p")[1], 1)}).drop("_p")
    else:
        exact = exact_percentiles(recent, ["pipeline_name"], "duration_seconds", {"p50": 0.5, "p95": 0.95})
        table = recent.groupBy("pipeline_name").agg(*aggs).join(
            exact.select("pipeline_name", rnd(F.col("p50"), 1).alias("p50_s"), rnd(F.col("p95"), 1).alias("p95_s")), "pipeline_name", "left")
    return table if top is None else table.orderBy(F.desc_nulls_last("p95_s"), "pipeline_name").limit(top)


def daily_errors(runs: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Error rate, failed runs and p95 duration per day."""
    recent = runs.filter(F.col("started_at") >= back(as_of, f"{days} days")).select(
        F.to_date("started_at").alias("day"), "status", F.coalesce("duration_seconds", F.lit(0)).alias("seconds"))
    counts = recent.groupBy("day").agg(
        share_pct(~_ok()).alias("error_rate"), F.count("*").alias("total_runs"), F.count_if(~_ok()).alias("failed_runs"))
    p95 = exact_percentiles(recent, ["day"], "seconds", {"p95": 0.95})
    return counts.join(p95.select("day", rnd(F.col("p95"), 1).alias("p95_s")), "day").withColumn("date", F.date_format("day", "MMM dd"))


def overall_sla(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = runs.filter(F.col("started_at") >= back(as_of, f"{days} days")).withColumn(
        "seconds", F.coalesce("duration_seconds", F.lit(0)))
    p = exact_percentiles(recent, [], "seconds", {"p50": 0.5, "p95": 0.95}).select(
        rnd(F.col("p50"), 1).alias("global_p50"), rnd(F.col("p95"), 1).alias("global_p95"))
    counts = recent.agg(
        F.count("*").alias("total_runs"), share_pct(_ok(), 2).alias("overall_success_rate"),
        F.count_if(F.col("duration_seconds") > SLA_LIMIT_SECONDS).alias("total_sla_breaches"))
    # Both sides are one aggregate row.
    return counts.crossJoin(F.broadcast(p))


def run_stats(runs: DataFrame, keys: list[str] = ()) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("*").alias("total_runs"), F.coalesce(F.sum("records_loaded"), F.lit(0)).alias("total_rows"),
        rnd(ratio_sum(F.col("duration_seconds")), 1).alias("avg_duration_s"), share_pct(_ok()).alias("success_rate"),
        F.max("started_at").alias("last_run_at"))


def flows_with_last_run(flows: DataFrame, runs: DataFrame) -> DataFrame:
    last = newest_runs(runs.select("pipeline_name", *LATEST), 1).select(
        "pipeline_name", "run_no", "status", "records_loaded", "started_at")
    return flows.join(last, "pipeline_name", "left")


def incident_counts(incidents: DataFrame) -> DataFrame:
    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    s = F.col("status")
    return incidents.agg(
        F.count("*").alias("total"), n(s == "pending_approval", "pending"), n(F.col("outcome") == "approved", "approved"),
        n(s == "rejected", "rejected"), n(s.isin("auto_healed", "resolved"), "deployed"))


def incident_page(incidents: DataFrame, status: str | None, limit: int, offset: int) -> DataFrame:
    """One page, newest first, with the total and whether more follow."""
    chosen = incidents.filter(F.col("status") == status) if status else incidents
    total = chosen.agg(F.count("*")).scalar()
    page = chosen.orderBy(F.desc("detection_at"), F.desc("incident_id")).offset(offset).limit(limit)
    return page.withColumns({"total": total, "has_more": total > offset + limit})


def runs_chart(runs: DataFrame, flows: list[str], as_of: Column, days: int = 7) -> DataFrame:
    """Date by flow table of records loaded."""
    recent = runs.filter(F.col("started_at") >= back(as_of, f"{days} days"))
    return recent.groupBy(F.to_date("started_at").alias("day")).pivot("pipeline_name", flows).sum("records_loaded")


def recovery(incidents: DataFrame, as_of: Column) -> DataFrame:
    """Mean minutes to recover of healed incidents (never negative) and anomalies of the last 24 hours."""
    took = F.greatest(seconds_between(F.col("detection_at"), F.col("resolved_at")), F.lit(0).cast("decimal(20,6)"))
    healed = F.col("status").isin("auto_healed", "resolved") & F.col("resolved_at").isNotNull()
    dated = incidents.select("status", "detection_at", "resolved_at", as_of.alias("as_of"))
    return dated.agg(
        rnd(ratio_sum(F.when(healed, took)) / 60.0, 0).alias("mttr_minutes"),
        F.count_if(F.col("detection_at") >= back(F.col("as_of"), "24 hours")).alias("anomalies_24h"))


def breakdown(incidents: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = incidents.filter(F.col("detection_at") >= back(as_of, f"{days} days"))
    return recent.groupBy(F.replace(F.col("anomaly_type"), F.lit("_"), F.lit(" ")).alias("name")).agg(F.count("*").alias("value"))


def improving(trend: DataFrame, order: str, value: str) -> DataFrame:
    """First three against last three points of a trend and the % change from first to last.

    The trend has one row per calendar day, so its window is small.
    """
    up, down, total = W.orderBy(order), W.orderBy(F.desc(order)), W.partitionBy()
    v = F.col(value)
    ranked = trend.withColumns({"a": F.row_number().over(up), "z": F.row_number().over(down), "n": F.count("*").over(total)})
    both = ranked.agg(
        F.avg(F.when(F.col("a") <= 3, v)).alias("head"), F.avg(F.when(F.col("z") <= 3, v)).alias("tail"),
        F.max(F.when(F.col("a") == 1, v)).alias("first"), F.max(F.when(F.col("z") == 1, v)).alias("last"), F.max("n").alias("n"))
    enough = F.col("n") >= 4
    return both.select(
        F.coalesce(enough & (F.col("tail") < F.col("head")), F.lit(False)).alias("improving"),
        F.when(enough, rnd((F.col("first") - F.col("last")) / F.nullif(F.col("first"), F.lit(0.0)) * 100, 0)).alias("improvement_pct"))


def sla_compliance(runs: DataFrame, as_of: Column, sla: dict[str, int] | None = None, days: int = 7) -> DataFrame:
    """Completed runs within target, % and durations per flow."""
    target = decode(F.col("pipeline_name"), SLA_SECONDS if sla is None else sla, DEFAULT_SLA_SECONDS)
    recent = runs.filter((F.col("started_at") >= back(as_of, f"{days} days")) & F.col("completed_at").isNotNull())
    within = F.col("duration_seconds") <= F.col("sla_target")
    return recent.withColumn("sla_target", target).groupBy("pipeline_name", "sla_target").agg(
        F.count("*").alias("total_runs"), F.count_if(within).alias("within_sla"), share_pct(within).alias("compliance_pct"),
        rnd(ratio_sum(F.col("duration_seconds")), 0).alias("avg_duration"), rnd(F.max("duration_seconds"), 0).alias("max_duration"))


def upstream_health(runs: DataFrame, as_of: Column) -> DataFrame:
    recent = runs.filter(F.col("started_at") >= back(as_of, "30 minutes"))
    return recent.groupBy("pipeline_name").agg(F.count_if(_ok()).alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))


def digest(runs: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    """Totals over the newest n runs of the last 24 hours."""
    recent = runs.filter(F.col("started_at") > back(as_of, "24 hours"))
    newest = recent.orderBy(F.desc("started_at"), F.desc("run_no")).limit(n)
    return newest.agg(F.count("*").alias("total"), F.count_if(_ok()).alias("success"), F.count_if(~_ok()).alias("failed"),
                      F.coalesce(F.sum("records_loaded"), F.lit(0)).alias("total_rows"))


def deliveries(sent: DataFrame, reports: DataFrame, n: int) -> DataFrame:
    """Newest report deliveries with their report's name and type."""
    return sent.join(reports, "report_id").orderBy(F.desc("sent_at"), F.desc("delivery_id")).limit(n)
