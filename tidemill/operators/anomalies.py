"""Anomaly detection over run history, for all flows in one job.

A flow's whole state is one aggregate row, so a flow with a third of all runs costs one partial
value per task: its newest run, its newest run that did not fail, and its measures. The failures in a
row, of any number, are the runs after that one, counted by a second aggregate. Only the three newest
failures per flow leave the scan stage as rows, limited before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import constants as k
from tidemill.functions.exprs import back, dbl, decode, ratio_sum, rnd, safe_divide
from tidemill.session import cut_lineage

LATEST = ["run_no", "records_ingested", "records_loaded", "records_failed", "status", "error_message",
          "started_at", "completed_at", "duration_seconds", "null_rate", "duplicate_rate"]



def classify_error(message: Column) -> Column:
    """First matching signature's type; UNKNOWN for no text, null for no match."""
    lower = F.lower(message)
    hits = F.coalesce(*[F.when(F.contains(lower, F.lit(s)), F.lit(t)) for s, t in k.ERROR_SIGNATURES])
    return F.when(F.coalesce(F.length(message), F.lit(0)) == 0, "UNKNOWN").otherwise(hits)


def category(anomaly_type: Column) -> Column:
    return decode(anomaly_type, k.ANOMALY_CATEGORY, "unknown")


def latest_run(runs: DataFrame) -> DataFrame:
    return newest_runs(runs.select("pipeline_name", *LATEST), 1).drop("rn")


def _seven_day_aggs(keep: Column) -> list[Column]:
    def mean(c: str) -> Column:
        return ratio_sum(F.when(keep, F.col(c)))

    return [
        mean("records_loaded").alias("avg_loaded"), mean("records_ingested").alias("avg_ingested"),
        mean("records_failed").alias("avg_failed"), mean("duration_seconds").alias("avg_duration"),
        F.stddev_samp(F.when(keep, F.col("records_loaded"))).alias("std_loaded"),
    ]


def seven_day_stats(runs: DataFrame, as_of: Column) -> DataFrame:
    """Means and deviation of the successful runs of the last 7 days."""
    recent = runs.filter((F.col("started_at") >= back(as_of, "7 days")) & (F.col("status") == "success"))
    return recent.groupBy("pipeline_name").agg(*_seven_day_aggs(F.lit(True)))


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The n newest runs per flow with their rank ``rn``."""
    w = W.partitionBy("pipeline_name").orderBy(F.desc("started_at"), F.desc("run_no"))
    return runs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Failures in a row ending at the newest run, however many, per flow."""
    broken = cut_lineage(runs.groupBy("pipeline_name").agg(_last_break()), "breaks")
    return _streaks(runs, broken)


def _last_break() -> Column:
    """The newest run that did not fail."""
    return F.max(F.when(F.col("status") != "failed", _run_order())).alias("last_break")


def _run_order() -> Column:
    return F.struct("started_at", "run_no")


def _streaks(runs: DataFrame, flows: DataFrame) -> DataFrame:
    """Runs after each flow's ``last_break``; ``flows`` is a written table, so the planner knows its size."""
    slim = runs.select("pipeline_name", _run_order().alias("at"))
    after = F.col("last_break").isNull() | (F.col("at") > F.col("last_break"))
    return slim.join(flows.select("pipeline_name", "last_break"), "pipeline_name").groupBy("pipeline_name").agg(
        F.count_if(after).cast("int").alias("consecutive_failures"))


def schema_drift_messages(runs: DataFrame, as_of: Column) -> DataFrame:
    """Newest of the last three failures of the past day whose message holds a schema word."""
    failed = runs.filter((F.col("status") == "failed") & (F.col("started_at") >= back(as_of, "1 days")))
    lower = F.lower(F.coalesce("error_message", F.lit("")))
    word = F.coalesce(*[F.when(F.contains(lower, F.lit(w)), F.lit(w)) for w in k.DRIFT_KEYWORDS])
    return (
        newest_runs(failed.select("pipeline_name", "started_at", "run_no", "error_message"), 3)
        .select("pipeline_name", "rn", F.substring(lower, 1, 200).alias("error_sample"), word.alias("drift_keyword"))
        .filter(F.col("drift_keyword").isNotNull())
        .groupBy("pipeline_name").agg(F.min_by(F.struct("error_sample", "drift_keyword"), "rn").alias("d"))
        .select("pipeline_name", "d.*")
    )


def flow_state(runs: DataFrame, as_of: Column) -> DataFrame:
    """One row per flow with everything the rules read.

    Three passes: one aggregate (newest run, newest run that did not fail, measures), the count of the runs after the
    latter, and the last failures (time filter pushed to the scan).
    """
    keyed = runs if "kind" in runs.columns else runs.withColumn("kind", F.col("pipeline_name"))
    flows = cut_lineage(_measures(keyed, as_of), "flows")
    return (
        flows.select("*", "r.*").drop("r", "last_break")
        .join(_streaks(keyed, flows), "pipeline_name", "left")
        .join(schema_drift_messages(keyed, as_of), "pipeline_name", "left")
        .withColumn("as_of", as_of)
    )


def _measures(runs: DataFrame, as_of: Column) -> DataFrame:
    """Newest run, newest run that did not fail, 7-day means, last-hour failure share, last success, loads of two days."""
    at = F.col("started_at")
    dated = runs.select(
        "pipeline_name", at, "run_no", "status", F.struct("kind", *LATEST).alias("r"), (F.col("status") == "success").alias("ok"), "completed_at",
        "records_loaded", "records_ingested", "records_failed", "duration_seconds",
        F.when(F.col("records_ingested") > 0, safe_divide(F.col("records_failed"), F.col("records_ingested"))).otherwise(0.0)
        .alias("fail_share"),
        as_of.alias("as_of"),
    )
    ok = F.col("ok")
    today = F.date_trunc("day", F.col("as_of")).cast("timestamp_ntz")
    is_today = ok & (at >= today)
    is_yesterday = ok & (at >= back(today, "1 days")) & (at < today)
    return dated.groupBy("pipeline_name").agg(
        F.max_by("r", _run_order()).alias("r"), _last_break(),
        *_seven_day_aggs(ok & (at >= back(F.col("as_of"), "7 days"))),
        F.avg(F.when(ok & (at >= back(F.col("as_of"), "1 hours")), F.col("fail_share"))).alias("hour_fail_share"),
        F.max(F.when(ok, F.col("completed_at"))).alias("last_success_at"),
        F.coalesce(F.sum(F.when(is_today, F.col("records_loaded"))), F.lit(0)).alias("loaded_today"),
        F.coalesce(F.sum(F.when(is_yesterday, F.col("records_loaded"))), F.lit(0)).alias("loaded_yesterday"),
    )


def row_drop(current: Column, average: Column) -> Column:
    """Drop share when above the threshold, else null."""
    drop = (average - dbl(current)) / F.nullif(average, F.lit(0.0))
    return F.when((average > 0) & (drop > k.ROW_DROP_SHARE), drop)


def null_spike(rate: Column, baseline: Column) -> Column:
    return (baseline < k.NULL_BASELINE_SHARE) & (rate > baseline + k.NULL_SPIKE_SHARE)


def duplicate_spike(rate: Column, baseline: Column) -> Column:
    return rate > baseline + k.DUPLICATE_SPIKE_SHARE


def sla_breach(duration: Column, target: Column) -> Column:
    """Duration / target when above the breach factor, else null."""
    return F.when(dbl(duration) > dbl(target) * k.SLA_FACTOR, dbl(duration) / dbl(target))


def detect(runs: DataFrame, as_of: Column, sla: dict[str, int] | None = None,
           cascade_owner: str = "ingest_nyc_taxi") -> DataFrame:
    """Every rule that fires per flow at the time ``as_of``: (pipeline_name, run_no, rule, rule_order, anomaly_type, metric).

    Runs that start later are not seen, so history can be replayed at any time.
    """
    runs = runs.filter(F.col("started_at") <= as_of)
    sla = k.SLA_SECONDS if sla is None else sla
    zero = F.lit(0.0)
    kind_of = "kind" if "kind" in runs.columns else "pipeline_name"
    failed = F.col("status") == "failed"
    ingested = F.coalesce(F.nullif(F.col("avg_ingested"), zero), F.lit(1.0))
    # Values that several rules read are columns of their own, so the rules stay small enough to compile.
    state = flow_state(runs, as_of).withColumns({
        # Without a flow of the owner's kind, the first of the failing flows reports the cascade.
        "owner": F.coalesce(runs.filter(F.col(kind_of) == cascade_owner).agg(F.min("pipeline_name")).scalar(),
                            _recent_failures(runs, as_of).agg(F.min("pipeline_name")).scalar()),
        "failing": _recent_failures(runs, as_of).agg(F.count("*")).scalar(),
        "loaded": F.coalesce("records_loaded", F.lit(0)),
        "duration": F.coalesce(dbl(F.col("duration_seconds")), zero),
        "known_error": F.when(failed & (F.length("error_message") > 0), classify_error(F.col("error_message"))),
        "target": decode(F.col("kind"), sla, k.DEFAULT_SLA_SECONDS),
        "mean_loaded": F.coalesce("avg_loaded", zero),
        "mean_failed": F.coalesce("avg_failed", zero),
        "mean_ingested": ingested,
        "mean_duration": F.coalesce("avg_duration", zero),
        "hour_share": F.coalesce("hour_fail_share", zero),
        "lag": F.timestamp_diff("MICROSECOND", F.col("last_success_at"), F.col("as_of")) / F.lit(1000000.0),
    })
    at_least_one = F.greatest(F.col("mean_ingested"), F.lit(1.0))
    state = state.withColumns({
        "drop": row_drop(F.col("loaded"), F.col("mean_loaded")),
        "null_share": dbl(F.coalesce("records_failed", F.lit(0))) / at_least_one,
        "base_share": F.col("mean_failed") / at_least_one,
        "breach": sla_breach(F.col("duration"), F.col("target")),
    })
    owner, failing, loaded, duration = (F.col(c) for c in ("owner", "failing", "loaded", "duration"))
    drop, breach, lag, known_error = (F.col(c) for c in ("drop", "breach", "lag", "known_error"))
    null_share, base_share, hour_share = (F.col(c) for c in ("null_share", "base_share", "hour_share"))
    mean_failed, mean_ingested, mean_duration = (F.col(c) for c in ("mean_failed", "mean_ingested", "mean_duration"))
    ok, streak = F.col("status") == "success", F.col("consecutive_failures")
    flink, micro = F.col("kind") == "flink_job", F.col("kind") == "spark_streaming"
    micro_type = (
        F.when(known_error.isNotNull(), known_error).when(duration > k.MICRO_BATCH_SECONDS, "PIPELINE_DELAY")
        .when(ok & (loaded == 0), "ZERO_LOAD")
    )
    flink_type = F.when(known_error.isNotNull(), known_error).when(duration > k.CHECKPOINT_SECONDS, "CHECKPOINT_FAILURE")

    def t(name: str) -> Column:
        return F.lit(name)

    # (rule, fires, anomaly type, metric)
    rules = [
        ("zero_load", ok & (loaded == 0), t("ZERO_LOAD"), zero),
        ("consecutive_failures", streak >= k.MIN_CONSECUTIVE_FAILURES,
         F.coalesce(known_error, t("CONSECUTIVE_FAILURES")), dbl(streak)),
        ("schema_drift", F.col("drift_keyword").isNotNull(), t("SCHEMA_DRIFT"), zero),
        ("row_count_drop", drop.isNotNull(), t("ROW_COUNT_DROP"), drop),
        ("null_spike", (mean_failed / mean_ingested < k.NULL_BASELINE_SHARE) & (null_share > k.NULL_SPIKE_SHARE),
         t("NULL_SPIKE"), null_share),
        ("duplicate_spike", duplicate_spike(hour_share, base_share), t("DUPLICATE_SPIKE"), hour_share - base_share),
        ("sla_breach", breach.isNotNull(), t("SLA_BREACH"), breach),
        ("pipeline_delay", (mean_duration > 0) & (duration > mean_duration * k.DELAY_FACTOR), t("PIPELINE_DELAY"),
         duration / F.nullif(mean_duration, zero)),
        ("cdc_lag", (F.col("kind") == "kafka_consumer") & (lag > k.CDC_LAG_SECONDS), t("CDC_LAG"), lag),
        ("incremental_sync", (F.col("loaded_yesterday") > 0) & (F.col("loaded_today") == 0),
         t("INCREMENTAL_SYNC_FAILURE"), dbl(F.col("loaded_yesterday"))),
        ("cascading_failure", (F.col("pipeline_name") == owner) & (failing >= k.CASCADE_PIPELINES),
         t("CASCADING_FAILURE"), dbl(failing)),
        ("checkpoint_health", flink & flink_type.isNotNull(), flink_type, duration),
        ("micro_batch_health", micro & micro_type.isNotNull(), micro_type, duration),
    ]
    found = F.array(*[
        F.when(F.coalesce(fires, F.lit(False)), F.struct(
            F.lit(name).alias("rule"), F.lit(i + 1).alias("rule_order"), kind.alias("anomaly_type"),
            rnd(metric, 4).alias("metric")))
        for i, (name, fires, kind, metric) in enumerate(rules)
    ])
    fired = state.select("pipeline_name", "run_no", F.explode(found).alias("f")).filter(F.col("f").isNotNull())
    return fired.select("pipeline_name", "run_no", "f.*")


def with_model_outliers(findings: DataFrame, outliers: DataFrame) -> DataFrame:
    """Findings plus the newest runs a model calls outliers (pipeline_name, run_no, anomaly_type, decision), as the last rule."""
    rows = outliers.select(
        "pipeline_name", "run_no", F.lit("model_outlier").alias("rule"), F.lit(14).alias("rule_order"), "anomaly_type",
        rnd(F.col("decision"), 4).alias("metric"))
    return findings.unionByName(rows)


def beside_scores(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """Every finding, and every judged run (pipeline_name, run_no, decision, by_text) under the rule model_outlier with ``as_scored``.

    That is whether ``findings`` hold what the model says of the run: below 0 it is listed, with its decision as the metric and under the
    type its error text names (if none, under any but NORMAL); else it is not. A type that the model chose and its metric are left out.
    """
    said = judged.select("pipeline_name", "run_no", F.lit("model_outlier").alias("rule"), rnd(F.col("decision"), 4).alias("score"),
                         (F.col("decision") < 0).alias("outlier"), "by_text")
    kind, listed, by_model = F.col("anomaly_type"), F.col("rule_order").isNotNull(), F.col("rule") == "model_outlier"
    typed = F.when(F.col("by_text").isNotNull(), kind == F.col("by_text")).otherwise(kind != k.NO_FAILURE)
    right = (listed == F.col("outlier")) & (~listed | ((F.col("metric") == F.col("score")) & typed))
    return findings.join(said, ["pipeline_name", "run_no", "rule"], "full_outer").select(
        "pipeline_name", "run_no", "rule", F.coalesce("rule_order", F.lit(14)).alias("rule_order"),
        F.when(~by_model, kind).alias("anomaly_type"), F.when(~by_model, F.col("metric")).alias("metric"),
        F.when(by_model, F.coalesce(right, F.lit(False))).alias("as_scored"))


def winners(findings: DataFrame) -> DataFrame:
    """The first firing rule per flow."""
    rest = [c for c in findings.columns if c != "pipeline_name"]
    return findings.groupBy("pipeline_name").agg(F.min_by(F.struct(*rest), "rule_order").alias("w")).select("pipeline_name", "w.*")


def _recent_failures(runs: DataFrame, as_of: Column) -> DataFrame:
    at = F.col("started_at")
    recent = runs.filter((F.col("status") == "failed") & (at >= back(as_of, "30 minutes")) & (at <= as_of))
    return recent.groupBy("pipeline_name").agg(F.count("*").alias("failures"))


def failing_flows(runs: DataFrame, as_of: Column) -> DataFrame:
    """Flows that failed in the last 30 minutes, when at least three did."""
    failing = _recent_failures(runs, as_of)
    return failing.filter(failing.agg(F.count("*")).scalar() >= k.CASCADE_PIPELINES)


def partition_skew(df: DataFrame, key: str, table: str) -> DataFrame:
    """Largest key against the mean key size."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    ratio = safe_divide(F.max("n"), F.avg("n"))
    return sizes.agg(F.max("n").alias("max_rows"), rnd(F.avg("n"), 2).alias("avg_rows"), rnd(ratio, 4).alias("skew_ratio")).select(
        F.lit(table).alias("table_name"), F.lit(key).alias("key_column"), "max_rows", "avg_rows", "skew_ratio",
        (F.col("skew_ratio") > k.SKEW_RATIO).alias("skewed"))


def backlog(metrics: DataFrame) -> DataFrame:
    """Streaming measurements with more unprocessed rows than allowed."""
    return metrics.filter(F.col("consumer_lag") > k.BACKLOG_ROWS)


def boosted_confidence(base: Column, anomaly_type: Column) -> Column:
    return F.least(F.lit(1.0), base + decode(anomaly_type, k.CONFIDENCE_BOOST, 0.0))


def diagnose(findings: DataFrame) -> DataFrame:
    """Root cause text, base and boosted confidence, fix type and urgency per finding."""
    kind, metric = F.col("anomaly_type"), F.col("metric")
    known = {t: k.DIAGNOSES[t] for t in k.DIAGNOSES}

    def part(i: int) -> Column:
        return decode(kind, {t: v[i] for t, v in known.items()}, k.DIAGNOSIS_DEFAULT[i])

    shown = (
        F.when(kind == "ROW_COUNT_DROP", F.round(metric.cast("decimal(38,6)") * 100, 0).cast("bigint").cast("string"))
        .when(kind == "SLA_BREACH", F.round(metric.cast("decimal(38,6)"), 1).cast("decimal(18,1)").cast("string"))
        .otherwise(F.round(metric.cast("decimal(38,6)"), 0).cast("bigint").cast("string"))
    )
    text = part(0)
    for mark, value in (("{pipeline}", F.col("pipeline_name")), ("{metric}", shown), ("{type}", kind)):
        text = F.replace(text, F.lit(mark), value)
    base = part(1)
    return findings.select(
        "pipeline_name", "rule", "anomaly_type", text.alias("root_cause"), base.alias("confidence"),
        rnd(boosted_confidence(base, kind), 2).alias("boosted_confidence"),
        part(2).alias("suggested_fix_type"), part(3).alias("urgency"), category(kind).alias("category"),
    )


def remedy_for(anomaly_type: Column, root_cause: Column, pipeline: Column) -> Column:
    """Remediation name: by anomaly type, else by root-cause words, else by flow name, else logic."""
    text = F.lower(root_cause)
    chosen = decode(anomaly_type, k.REMEDIATION_FOR)
    words = [
        F.when(_any_of(text, list(ws)), F.lit(name)) for ws, name in k.REMEDIATION_KEYWORDS
    ]
    by_flow = F.when(_any_of(pipeline, ["kafka", "consumer"]), "cdc_lag")
    return F.coalesce(chosen, *words, by_flow, F.lit("logic"))


def _any_of(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def alerts(runs: DataFrame, as_of: Column, last_fired: DataFrame, anomaly_score: str = "confidence",
           sla: dict[str, int] | None = None, rules=None) -> DataFrame:
    """Alert rules against each flow's newest run and the run before it.

    ``last_fired`` (pipeline_name, condition, last_fired_at) mutes a rule within its cooldown.
    """
    sla = k.SLA_SECONDS if sla is None else sla
    rules = k.ALERT_RULES if rules is None else rules
    used = ["status", "null_rate", "records_loaded", "duration_seconds", anomaly_score, "daily_cost", "kind"]
    newest = newest_runs(runs.select("pipeline_name", "started_at", "run_no", *used), 2)
    two = newest.groupBy("pipeline_name").agg(
        F.min_by(F.struct(*used), "rn").alias("r"),
        F.max(F.when(F.col("rn") == 2, F.col("records_loaded"))).alias("prior_loaded"),
    )
    target = decode(F.col("r.kind"), sla, k.DEFAULT_SLA_SECONDS)
    drop_pct = 100.0 * safe_divide(F.col("prior_loaded") - F.col("r.records_loaded"), F.col("prior_loaded"))
    measure = {
        "pipeline_failure": F.when(F.col("r.status") == "failed", 1.0).otherwise(0.0),
        "anomaly": F.col(f"r.{anomaly_score}"),
        "null_spike": F.col("r.null_rate") * 100.0,
        "row_count_drop": F.coalesce(drop_pct, F.lit(0.0)),
        "sla_breach": F.when(dbl(F.col("r.duration_seconds")) > target, 1.0).otherwise(0.0),
        "cost_threshold": F.col("r.daily_cost"),
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("alert"), F.lit(condition).alias("condition"), F.lit(channel).alias("channel"),
                 F.lit(threshold).alias("threshold"), F.lit(cooldown).alias("cooldown_minutes"),
                 measure[condition].alias("value"))
        for name, condition, channel, threshold, cooldown, enabled in rules if enabled
    ])
    fired = two.select("pipeline_name", F.inline(rows)).filter(F.col("value") > F.col("threshold"))
    since = F.timestamp_diff("MINUTE", F.col("last_fired_at"), as_of)
    return fired.join(last_fired, ["pipeline_name", "condition"], "left").filter(
        F.col("last_fired_at").isNull() | (since >= F.col("cooldown_minutes"))
    ).select("pipeline_name", "alert", "condition", "channel", rnd(F.col("value"), 4).alias("value"))


# Schedule presets -> minutes.
SCHEDULE_MINUTES = {
    "*/30 * * * *": 30, "0 * * * *": 60, "0 */3 * * *": 180, "0 */6 * * *": 360, "0 */12 * * *": 720,
    "0 0 * * *": 1440, "@hourly": 60, "@daily": 1440,
}


def schedule_minutes(schedule: Column) -> Column:
    """Minutes between runs of a schedule text; null for none or an unknown form."""
    s = F.trim(schedule)
    every_minutes = F.nullif(F.regexp_extract(s, r"^\*/(\d+) \* \* \* \*$", 1), F.lit(""))
    every_hours = F.nullif(F.regexp_extract(s, r"^0 \*/(\d+) \* \* \*$", 1), F.lit(""))
    return F.coalesce(decode(s, SCHEDULE_MINUTES), every_minutes.cast("int"), every_hours.cast("int") * 60)


def overdue(flows: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Scheduled flows that never completed, or whose last completion is at least one interval ago."""
    done = runs.groupBy("pipeline_name").agg(F.max("completed_at").alias("last_completed_at"))
    minutes = schedule_minutes(F.col("schedule"))
    age = F.timestamp_diff("MICROSECOND", F.col("last_completed_at"), as_of) / F.lit(60000000.0)
    return flows.withColumn("interval_minutes", minutes).filter(F.col("interval_minutes").isNotNull()).join(
        done, "pipeline_name", "left"
    ).filter(F.col("last_completed_at").isNull() | (age >= F.col("interval_minutes"))).select(
        "pipeline_name", "schedule", "interval_minutes", "last_completed_at")
