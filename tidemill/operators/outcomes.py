"""Outcome and learning analytics over incidents and the fix library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.exprs import back, dbl, ratio_sum, rnd, safe_divide, seconds_between

SUCCESS = ["approved", "auto_healed"]
MAX_FAILURES = 2
DEFAULT_THRESHOLD, MIN_POINTS = 0.75, 3


def _succeeded() -> Column:
    return F.col("outcome").isin(SUCCESS)


def strategy_rates(outcomes: DataFrame) -> DataFrame:
    """(anomaly_type, healing_strategy): total, successes, success rate, mean time to recover."""
    n = F.count("*")
    return outcomes.groupBy("anomaly_type", "healing_strategy").agg(
        n.alias("total"),
        F.count_if(_succeeded()).alias("successes"),
        rnd(safe_divide(F.count_if(_succeeded()), n), 4).alias("success_rate"),
        rnd(F.coalesce(ratio_sum(F.col("mttr_seconds")), F.lit(0.0)), 2).alias("avg_mttr_seconds"),
    )


def best_strategy(rates: DataFrame) -> DataFrame:
    """Highest rate per anomaly type; on ties more successes, then the name."""
    rank = F.row_number().over(
        W.partitionBy("anomaly_type").orderBy(F.desc("success_rate"), F.desc("successes"), "healing_strategy"))
    return rates.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def mttr_trend(outcomes: DataFrame, days: int, as_of: Column) -> DataFrame:
    recent = outcomes.filter((F.col("resolved_at") >= back(as_of, f"{days} days")) & F.col("mttr_seconds").isNotNull())
    return recent.groupBy(F.to_date("resolved_at").alias("date")).agg(
        rnd(ratio_sum(F.col("mttr_seconds")), 2).alias("avg_mttr_seconds"), F.count("*").alias("incident_count"))


def totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("total_outcomes"),
        rnd(F.coalesce(ratio_sum(F.col("mttr_seconds")), F.lit(0.0)), 2).alias("avg_mttr"),
        rnd(F.coalesce(safe_divide(F.count_if(_succeeded()), F.count("*")), F.lit(0.0)), 4).alias("success_rate"),
    )


def top_anomalies(outcomes: DataFrame, n: int = 10) -> DataFrame:
    counts = outcomes.groupBy("anomaly_type").agg(F.count("*").alias("incidents"))
    return counts.orderBy(F.desc("incidents"), "anomaly_type").limit(n)


def weekly_improvement(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Mean recovery time of this week against the week that ended three weeks ago."""
    at, m = F.col("resolved_at"), F.col("mttr_seconds")
    dated = outcomes.select(at, m, as_of.alias("as_of"))
    now = F.col("as_of")
    week = F.coalesce(ratio_sum(F.when(at >= back(now, "7 days"), m)), F.lit(0.0))
    base = F.coalesce(ratio_sum(F.when((at >= back(now, "28 days")) & (at < back(now, "21 days")), m)), F.lit(0.0))
    both = dated.agg(week.alias("w"), base.alias("b"))
    change = (F.col("b") - F.col("w")) / F.nullif(F.col("b"), F.lit(0.0)) * 100
    return both.select(
        rnd(F.col("w"), 2).alias("this_week"), rnd(F.col("b"), 2).alias("four_weeks_ago"),
        F.when(F.col("b") > 0, rnd(change, 1)).otherwise(0.0).alias("weekly_improvement_pct"),
    )


def fix_library(outcomes: DataFrame) -> DataFrame:
    """Counters per fix from its outcome events; deprecated from the second failure on."""
    return outcomes.groupBy("fix_id", "anomaly_type").agg(
        F.count_if(_succeeded()).alias("success_count"),
        F.count_if(F.col("outcome") == "rejected").alias("failure_count"),
        (ratio_sum(F.col("mttr_seconds")) / 60.0).alias("mttr_minutes"),
    ).withColumn("deprecated", F.col("failure_count") >= MAX_FAILURES)


def apply_outcomes(fixes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fix counters increased by new outcome events; a fix stays or becomes deprecated."""
    new = outcomes.groupBy("fix_id").agg(
        F.count_if(_succeeded()).alias("_s"), F.count_if(F.col("outcome") == "rejected").alias("_f"))
    joined = fixes.join(new, "fix_id", "left")
    success = F.col("success_count") + F.coalesce("_s", F.lit(0))
    failure = F.col("failure_count") + F.coalesce("_f", F.lit(0))
    return joined.select("fix_id", "anomaly_type", success.alias("success_count"), failure.alias("failure_count"),
                         (F.col("deprecated") | (failure >= MAX_FAILURES)).alias("deprecated"))


def _live(fixes: DataFrame) -> DataFrame:
    return fixes.filter(~F.col("deprecated"))


def mttr_by_anomaly(fixes: DataFrame) -> DataFrame:
    minutes = F.sum(F.coalesce("mttr_minutes", F.lit(0.0)).cast("decimal(38,6)"))
    return _live(fixes).groupBy("anomaly_type").agg(rnd(safe_divide(minutes, F.count("*")), 1).alias("mttr_minutes"))


def fix_success(fixes: DataFrame) -> DataFrame:
    """Success % per anomaly type and overall (anomaly_type = 'ALL')."""
    runs = F.col("success_count") + F.col("failure_count")
    per_type = fixes.groupBy("anomaly_type").agg(F.sum("success_count").alias("s"), F.sum(runs).alias("n"))
    overall = per_type.agg(F.lit("ALL").alias("anomaly_type"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return per_type.unionByName(overall).filter(F.col("n") > 0).select(
        "anomaly_type", F.col("n").alias("total_fixes"), rnd(100.0 * safe_divide(F.col("s"), F.col("n")), 1).alias("success_pct"))


def learned_threshold(fixes: DataFrame) -> DataFrame:
    """Confidence threshold per anomaly type, learned from at least three used fixes, else the default."""
    n = F.col("success_count") + F.col("failure_count")
    used = _live(fixes).filter(n > 0).withColumn("t", (0.60 + 0.35 * safe_divide(F.col("success_count"), n)).cast("decimal(38,6)"))
    learned = F.least(F.lit(0.95), F.greatest(F.lit(0.60), rnd(safe_divide(F.sum("t"), F.count("*")), 3)))
    return used.groupBy("anomaly_type").agg(
        F.when(F.count("*") < MIN_POINTS, DEFAULT_THRESHOLD).otherwise(learned).alias("threshold"), F.count("*").alias("points"))


def query_quality(rows: Column, execution_ms: Column, feedback: Column) -> Column:
    score = (
        F.lit(0.5) + F.when(rows > 0, 0.2).otherwise(0.0)
        + F.when(execution_ms < 2000, 0.1).when(execution_ms > 10000, -0.1).otherwise(0.0) + feedback * 0.2
    )
    return rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def derive_outcome(incidents: DataFrame, code: str, now: Column) -> DataFrame:
    """Recovery seconds up to ``now`` and the 16-character fingerprint of the fix code."""
    return incidents.withColumns({
        "mttr_seconds": seconds_between(F.col("detection_at"), now),
        "fix_code_hash": F.substring(F.sha2(F.col(code), 256), 1, 16),
    })


def summary(fixes: DataFrame) -> DataFrame:
    """Unweighted mean of the per-anomaly recovery minutes and the five types with the best rate."""
    mean = mttr_by_anomaly(fixes).agg(rnd(safe_divide(F.sum(F.col("mttr_minutes").cast("decimal(38,6)")), F.count("*")), 1)).scalar()
    top = fix_success(fixes).filter(F.col("anomaly_type") != "ALL").orderBy(F.desc("success_pct"), "anomaly_type").limit(5)
    return top.select("anomaly_type", "success_pct", mean.alias("avg_mttr_minutes"))


def elapsed(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("elapsed_seconds", dbl(seconds_between(F.col("detection_at"), F.col("resolved_at"))))
