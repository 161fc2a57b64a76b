"""Queries: anomaly rules over run history, diagnosis, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import constants as k
from tidemill.functions.exprs import pick, rnd
from tidemill.operators import anomalies as an
from tidemill.plans.oracle import AS_OF, AVG, D, R, case, lit
from tidemill.plans.registry import query

_ERR = "CASE WHEN coalesce(length({m}), 0) = 0 THEN 'UNKNOWN' " + " ".join(
    f"WHEN contains(lower({{m}}), {lit(s)}) THEN {lit(t)}" for s, t in k.ERROR_SIGNATURES) + " END"
_KEYWORD = "CASE " + " ".join(f"WHEN contains(lower(error_message), {lit(w)}) THEN {lit(w)}" for w in k.DRIFT_KEYWORDS) + " END"


def _state(source: str, as_of: str = AS_OF) -> str:
    """Per-flow state over ``source`` (fleet or runs with kind) at a time."""
    runs = "seen"
    return f"""
    clock AS (SELECT {as_of} AS as_of), seen AS (SELECT s.* FROM {source} s, clock WHERE started_at <= as_of),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pipeline_name ORDER BY started_at DESC, run_no DESC) AS rn FROM {runs}),
    latest AS (SELECT * FROM ranked WHERE rn = 1),
    stats AS (SELECT pipeline_name, {AVG('records_loaded')} AS avg_loaded, {AVG('records_ingested')} AS avg_ingested,
        {AVG('records_failed')} AS avg_failed, {AVG('duration_seconds')} AS avg_duration, stddev_samp(records_loaded) AS std_loaded
        FROM {runs}, clock WHERE started_at >= as_of - INTERVAL 7 DAY AND status = 'success' GROUP BY 1),
    streak AS (SELECT pipeline_name, coalesce(min(rn - 1) FILTER (WHERE status <> 'failed'), max(rn)) AS consecutive_failures
        FROM ranked GROUP BY 1),
    f3 AS (SELECT pipeline_name, error_message, row_number() OVER (PARTITION BY pipeline_name ORDER BY started_at DESC, run_no DESC) AS rn
        FROM {runs}, clock WHERE status = 'failed' AND started_at >= as_of - INTERVAL 1 DAY),
    drift AS (SELECT pipeline_name, arg_min(left(lower(error_message), 200), rn) AS error_sample, arg_min({_KEYWORD}, rn) AS drift_keyword
        FROM f3 WHERE rn <= 3 AND {_KEYWORD} IS NOT NULL GROUP BY 1),
    win AS (SELECT pipeline_name,
        avg(CASE WHEN records_ingested > 0 THEN CAST(records_failed AS DOUBLE) / records_ingested ELSE 0.0 END)
            FILTER (WHERE status = 'success' AND started_at >= as_of - INTERVAL 1 HOUR) AS hour_fail_share,
        max(completed_at) FILTER (WHERE status = 'success') AS last_success_at,
        CAST(coalesce(sum(records_loaded) FILTER (WHERE status = 'success' AND started_at >= date_trunc('day', as_of)), 0) AS BIGINT) AS loaded_today,
        CAST(coalesce(sum(records_loaded) FILTER (WHERE status = 'success' AND started_at >= date_trunc('day', as_of) - INTERVAL 1 DAY
            AND started_at < date_trunc('day', as_of)), 0) AS BIGINT) AS loaded_yesterday,
        count(*) FILTER (WHERE status = 'failed' AND started_at >= as_of - INTERVAL 30 MINUTE) AS failed_30m
        FROM {runs}, clock GROUP BY 1),
    state AS (SELECT l.*, coalesce(avg_loaded, 0) AS al, coalesce(avg_failed, 0) AS af, coalesce(nullif(avg_ingested, 0), 1.0) AS ai,
        greatest(coalesce(nullif(avg_ingested, 0), 1.0), 1.0) AS ai1, coalesce(avg_duration, 0) AS ad, consecutive_failures AS cf,
        drift_keyword, coalesce(hour_fail_share, 0) AS hs, loaded_today, loaded_yesterday, CAST(l.duration_seconds AS DOUBLE) AS dur,
        (epoch_us(as_of) - epoch_us(last_success_at)) / 1000000.0::DOUBLE AS lag, {case('l.kind', k.SLA_SECONDS, 3600)} AS target,
        CASE WHEN l.status = 'failed' AND length(l.error_message) > 0 THEN {_ERR.format(m='l.error_message')} END AS err,
        (SELECT count(*) FROM win WHERE failed_30m > 0) AS failing, coalesce((SELECT min(pipeline_name) FROM latest WHERE kind = 'ingest_nyc_taxi'), (SELECT min(pipeline_name) FROM win WHERE failed_30m > 0)) AS owner
        FROM latest l CROSS JOIN clock LEFT JOIN stats s USING (pipeline_name) LEFT JOIN streak USING (pipeline_name)
        LEFT JOIN drift USING (pipeline_name) LEFT JOIN win USING (pipeline_name))"""


_RULES = [
    ("zero_load", "status = 'success' AND coalesce(records_loaded, 0) = 0", "'ZERO_LOAD'", "0.0"),
    ("consecutive_failures", "cf >= 2", "coalesce(err, 'CONSECUTIVE_FAILURES')", "cf"),
    ("schema_drift", "drift_keyword IS NOT NULL", "'SCHEMA_DRIFT'", "0.0"),
    ("row_count_drop", "al > 0 AND (al - coalesce(records_loaded, 0)) / nullif(al, 0) > 0.20", "'ROW_COUNT_DROP'", "(al - coalesce(records_loaded, 0)) / al"),
    ("null_spike", "af / ai < 0.02 AND coalesce(records_failed, 0) / ai1 > 0.10", "'NULL_SPIKE'", "coalesce(records_failed, 0) / ai1"),
    ("duplicate_spike", "hs > af / ai1 + 0.05", "'DUPLICATE_SPIKE'", "hs - af / ai1"),
    ("sla_breach", "dur > target * 3.0", "'SLA_BREACH'", "dur / target"),
    ("pipeline_delay", "ad > 0 AND dur > 2 * ad", "'PIPELINE_DELAY'", "dur / ad"),
    ("cdc_lag", "kind = 'kafka_consumer' AND lag > 300", "'CDC_LAG'", "lag"),
    ("incremental_sync", "loaded_yesterday > 0 AND loaded_today = 0", "'INCREMENTAL_SYNC_FAILURE'", "loaded_yesterday"),
    ("cascading_failure", "pipeline_name = owner AND failing >= 3", "'CASCADING_FAILURE'", "failing"),
    ("checkpoint_health", "kind = 'flink_job' AND (err IS NOT NULL OR dur > 120)", "coalesce(err, 'CHECKPOINT_FAILURE')", "dur"),
    ("micro_batch_health", "kind = 'spark_streaming' AND (err IS NOT NULL OR dur > 60 OR (status = 'success' AND coalesce(records_loaded, 0) = 0))",
     "coalesce(err, CASE WHEN dur > 60 THEN 'PIPELINE_DELAY' ELSE 'ZERO_LOAD' END)", "dur"),
]


def _findings(runs: str, as_of: str = AS_OF) -> str:
    parts = [f"""SELECT pipeline_name, run_no, {lit(name)} AS rule, {i + 1} AS rule_order, {kind} AS anomaly_type,
        {R(metric, 4)} AS metric FROM state WHERE {cond}""" for i, (name, cond, kind, metric) in enumerate(_RULES)]
    return f"{_state(runs, as_of)}, findings AS ({' UNION ALL '.join(parts)}), winners AS (SELECT * EXCLUDE rk FROM (SELECT *, " \
           "row_number() OVER (PARTITION BY pipeline_name ORDER BY rule_order) AS rk FROM findings) WHERE rk = 1)"


_SIX = "six AS (SELECT *, pipeline_name AS kind FROM runs)"


@query("a00_unhealthy_report", f"WITH {_SIX}, {_findings('six')} SELECT * FROM winners", "runs")
def _(t):
    return an.winners(an.detect(t.runs, t.as_of))


@query("a00_latest_run", f"""WITH {_SIX}, {_state('six')} SELECT pipeline_name, run_no, records_ingested, records_loaded, records_failed, status, error_message,
    started_at, completed_at, {D('duration_seconds')} AS duration_seconds, null_rate, duplicate_rate FROM latest""", "runs")
def _(t):
    return an.latest_run(t.runs)


@query("a00_seven_day_stats", f"""WITH {_state('fleet')} SELECT pipeline_name, {R('avg_loaded', 4)} AS avg_loaded, {R('avg_ingested', 4)} AS avg_ingested,
    {R('avg_failed', 4)} AS avg_failed, {R('avg_duration', 4)} AS avg_duration, {R('std_loaded', 4)} AS std_loaded FROM stats""", "fleet")
def _(t):
    stats = an.seven_day_stats(t.fleet, t.as_of)
    return stats.select("pipeline_name", *[rnd(F.col(c), 4).alias(c) for c in stats.columns[1:]])


@query("a00_consecutive_failures", f"WITH {_state('fleet')} SELECT pipeline_name, CAST(consecutive_failures AS INTEGER) AS consecutive_failures FROM streak", "fleet")
def _(t):
    return an.consecutive_failures(t.fleet)


# One flow fails in all its runs but the first: a streak of all the others, over a thousand at sf0.01.
_BROKEN = """broken AS (SELECT * REPLACE (CASE WHEN pipeline_name = 'kafka_consumer' AND run_no > (
        SELECT min(run_no) FROM runs WHERE pipeline_name = 'kafka_consumer') THEN 'failed' ELSE status END AS status),
    pipeline_name AS kind FROM runs)"""


def _broken(t):
    one = F.col("pipeline_name") == "kafka_consumer"
    first = t.runs.filter(one).agg(F.min("run_no")).scalar()
    return t.runs.withColumn("status", F.when(one & (F.col("run_no") > first), "failed").otherwise(F.col("status")))


@query("a02_long_streak", f"WITH {_BROKEN}, {_state('broken')} SELECT pipeline_name, CAST(consecutive_failures AS INTEGER) AS consecutive_failures FROM streak", "runs")
def _(t):
    return an.consecutive_failures(_broken(t))


@query("a18_long_streak", f"WITH {_BROKEN}, {_findings('broken')} SELECT * FROM findings", "runs")
def _(t):
    return an.detect(_broken(t), t.as_of)


# A time at which several flows fail together.
_OUTAGE = "2024-01-27 07:30:00"


def _register_rules():
    for i, (rule, *_rest) in enumerate(_RULES):
        if rule == "cascading_failure":
            continue
        name = rule.replace("pipeline_delay", "run_delay")

        @query(f"a{i + 1:02d}_{name}", f"WITH {_findings('fleet')} SELECT * FROM findings WHERE rule = {lit(rule)}", "fleet")
        def _(t, rule=rule):
            return an.detect(t.fleet, t.as_of).filter(F.col("rule") == rule)


_register_rules()


def _outage():
    return F.lit(_OUTAGE).cast("timestamp_ntz")


@query("a11_cascading_failure", f"WITH {_findings('fleet', f'TIMESTAMP {lit(_OUTAGE)}')} SELECT * FROM findings WHERE rule = 'cascading_failure'", "fleet")
def _(t):
    return an.detect(t.fleet, _outage()).filter(F.col("rule") == "cascading_failure")


@query("a03_schema_drift_messages", f"WITH {_state('fleet')} SELECT * FROM drift", "fleet")
def _(t):
    return an.schema_drift_messages(t.fleet, t.as_of)


@query("a05_null_spike_standalone", f"""WITH {_state('fleet')} SELECT pipeline_name, {R('null_rate', 4)} AS null_rate FROM state
    WHERE af / ai1 < 0.02 AND null_rate > af / ai1 + 0.10""", "fleet")
def _(t):
    s = _with_baseline(t)
    return s.filter(an.null_spike(F.col("null_rate"), F.col("baseline"))).select("pipeline_name", rnd(F.col("null_rate"), 4).alias("null_rate"))


@query("a06_duplicate_spike_standalone", f"""WITH {_state('fleet')} SELECT pipeline_name, {R('duplicate_rate', 4)} AS duplicate_rate FROM state
    WHERE duplicate_rate > af / ai1 + 0.05""", "fleet")
def _(t):
    s = _with_baseline(t)
    return s.filter(an.duplicate_spike(F.col("duplicate_rate"), F.col("baseline"))).select(
        "pipeline_name", rnd(F.col("duplicate_rate"), 4).alias("duplicate_rate"))


def _with_baseline(t):
    one, zero = F.lit(1.0), F.lit(0.0)
    ingested = F.greatest(F.coalesce(F.nullif(F.col("avg_ingested"), zero), one), one)
    return an.latest_run(t.fleet).join(an.seven_day_stats(t.fleet, t.as_of), "pipeline_name", "left").withColumn(
        "baseline", F.coalesce("avg_failed", zero) / ingested)


@query("a11_failing_flows", f"""WITH f AS (SELECT pipeline_name, count(*) AS failures FROM fleet
        WHERE status = 'failed' AND started_at BETWEEN TIMESTAMP {lit(_OUTAGE)} - INTERVAL 30 MINUTE AND TIMESTAMP {lit(_OUTAGE)} GROUP BY 1)
    SELECT * FROM f WHERE (SELECT count(*) FROM f) >= 3""", "fleet")
def _(t):
    return an.failing_flows(t.fleet, _outage())


@query("a15_classify_errors", f"""SELECT error_message, {_ERR.format(m='error_message')} AS anomaly_type, count(*) AS n FROM runs GROUP BY 1, 2""", "runs")
def _(t):
    return t.runs.groupBy("error_message").agg(F.count("*").alias("n")).select(
        "error_message", an.classify_error(F.col("error_message")).alias("anomaly_type"), "n")


def _skew(table: str, key: str) -> str:
    return f"""SELECT {lit(table)} AS table_name, {lit(key)} AS key_column, max(n) AS max_rows, {R('avg(n)', 2)} AS avg_rows,
        {R('max(n) / avg(n)', 4)} AS skew_ratio, {R('max(n) / avg(n)', 4)} > 5.0 AS skewed FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY 1)"""


@query("a16_partition_skew", " UNION ALL ".join([_skew("lineitem", "l_partkey"), _skew("events", "user_id"), _skew("documents", "source")]))
def _(t):
    return an.partition_skew(t.lineitem, "l_partkey", "lineitem").unionByName(
        an.partition_skew(t.events, "user_id", "events")).unionByName(an.partition_skew(t.documents, "source", "documents"))


@query("a17_streaming_backlog", "SELECT pipeline_name, engine, recorded_at, consumer_lag FROM stream_metrics WHERE consumer_lag > 100000", "stream_metrics")
def _(t):
    return an.backlog(t.stream_metrics).select("pipeline_name", "engine", "recorded_at", "consumer_lag")


@query("a18_findings", f"WITH {_findings('fleet')} SELECT * FROM findings", "fleet")
def _(t):
    return an.detect(t.fleet, t.as_of)


@query("a18_winners", f"WITH {_findings('fleet')} SELECT * FROM winners", "fleet")
def _(t):
    return an.winners(an.detect(t.fleet, t.as_of))


@query("a19_anomaly_category", f"SELECT {case('anomaly_type', k.ANOMALY_CATEGORY, 'unknown')} AS category, count(*) AS incidents FROM incidents GROUP BY 1", "incidents")
def _(t):
    return t.incidents.groupBy(an.category(F.col("anomaly_type")).alias("category")).agg(F.count("*").alias("incidents"))


def _diag(i: int) -> str:
    return case("anomaly_type", {t: v[i] for t, v in k.DIAGNOSES.items()}, k.DIAGNOSIS_DEFAULT[i])


_SHOWN = """CASE anomaly_type WHEN 'ROW_COUNT_DROP' THEN CAST(CAST(round(CAST(metric AS DECIMAL(38,6)) * 100, 0) AS BIGINT) AS VARCHAR)
    WHEN 'SLA_BREACH' THEN CAST(CAST(round(CAST(metric AS DECIMAL(38,6)), 1) AS DECIMAL(18,1)) AS VARCHAR)
    ELSE CAST(CAST(round(CAST(metric AS DECIMAL(38,6)), 0) AS BIGINT) AS VARCHAR) END"""


@query("a20_diagnosis", f"""WITH {_findings('fleet')} SELECT pipeline_name, rule, anomaly_type,
    replace(replace(replace({_diag(0)}, '{{pipeline}}', pipeline_name), '{{metric}}', {_SHOWN}), '{{type}}', anomaly_type) AS root_cause,
    CAST({_diag(1)} AS DOUBLE) AS confidence, {R(f"least(1.0, {_diag(1)} + {case('anomaly_type', k.CONFIDENCE_BOOST, 0.0)})", 2)} AS boosted_confidence,
    {_diag(2)} AS suggested_fix_type, {_diag(3)} AS urgency, {case('anomaly_type', k.ANOMALY_CATEGORY, 'unknown')} AS category FROM findings""", "fleet")
def _(t):
    return an.diagnose(an.detect(t.fleet, t.as_of))


@query("a21_confidence_boost", f"""SELECT incident_id, {R(f"least(1.0, confidence_score + {case('anomaly_type', k.CONFIDENCE_BOOST, 0.0)})", 2)} AS confidence
    FROM incidents""", "incidents")
def _(t):
    return t.incidents.select("incident_id", rnd(an.boosted_confidence(F.col("confidence_score"), F.col("anomaly_type")), 2).alias("confidence"))


_REMEDY_WORDS = " ".join(f"WHEN {' OR '.join(f'contains(rc, {lit(w)})' for w in ws)} THEN {lit(name)}" for ws, name in k.REMEDIATION_KEYWORDS)


def _scored_runs(t):
    return t.fleet.withColumns({
        "confidence": F.col("records_failed") / F.lit(100.0),
        "daily_cost": F.col("duration_seconds").cast("double") / 20.0,
    })


_ALERTS = f"""WITH r AS (SELECT *, CAST(records_failed AS DOUBLE) / 100.0 AS confidence, CAST(duration_seconds AS DOUBLE) / 20.0 AS daily_cost,
        row_number() OVER (PARTITION BY pipeline_name ORDER BY started_at DESC, run_no DESC) AS rn FROM fleet),
    two AS (SELECT a.*, p.records_loaded AS prior FROM r a LEFT JOIN r p ON p.pipeline_name = a.pipeline_name AND p.rn = 2 WHERE a.rn = 1),
    v AS (SELECT pipeline_name, unnest([
        {{alert: 'Pipeline Failure Alert', condition: 'pipeline_failure', channel: 'slack', threshold: 0.0::DOUBLE, cool: 60, value: CASE WHEN status = 'failed' THEN 1.0::DOUBLE ELSE 0.0 END}},
        {{alert: 'Anomaly Detected', condition: 'anomaly', channel: 'slack', threshold: 0.8::DOUBLE, cool: 120, value: confidence}},
        {{alert: 'Null Spike Alert', condition: 'null_spike', channel: 'slack', threshold: 20.0::DOUBLE, cool: 60, value: null_rate * 100.0}},
        {{alert: 'Row Count Drop', condition: 'row_count_drop', channel: 'slack', threshold: 30.0::DOUBLE, cool: 30, value: coalesce(100.0::DOUBLE * (prior - records_loaded) / nullif(prior, 0), 0.0)}},
        {{alert: 'SLA Breach', condition: 'sla_breach', channel: 'pagerduty', threshold: 0.0::DOUBLE, cool: 30, value: CASE WHEN duration_seconds > {case('kind', k.SLA_SECONDS, 3600)} THEN 1.0::DOUBLE ELSE 0.0 END}},
        {{alert: 'Cost Threshold Exceeded', condition: 'cost_threshold', channel: 'email', threshold: 50.0::DOUBLE, cool: 1440, value: daily_cost}}], recursive := true) FROM two),
    lf AS (SELECT pipeline_name, 'pipeline_failure' AS condition, max(started_at) AS last_fired_at FROM r WHERE status = 'failed' AND rn > 1 GROUP BY 1)
    SELECT v.pipeline_name, v.alert, v.condition, channel, {R('value', 4)} AS value FROM v
    LEFT JOIN lf ON lf.pipeline_name = v.pipeline_name AND lf.condition = v.condition
    WHERE value > threshold AND (last_fired_at IS NULL OR (epoch_us({AS_OF}) - epoch_us(last_fired_at)) // 60000000 >= cool)"""


def _last_failures(t):
    runs = _scored_runs(t)
    older = an.latest_run(runs).select("pipeline_name", F.col("run_no").alias("newest"))
    return (
        runs.filter(F.col("status") == "failed").join(older, "pipeline_name").filter(F.col("run_no") != F.col("newest"))
        .groupBy("pipeline_name").agg(F.max("started_at").alias("last_fired_at"))
        .withColumn("condition", F.lit("pipeline_failure"))
    )


@query("a22_alerts", _ALERTS, "fleet")
def _(t):
    everything_on = [(*rule[:5], True) for rule in k.ALERT_RULES]
    return an.alerts(_scored_runs(t), t.as_of, _last_failures(t), rules=everything_on)


_OFF = ", ".join(lit(rule[1]) for rule in k.ALERT_RULES if not rule[5])


@query("a22_alerts_enabled", f"SELECT * FROM ({_ALERTS}) WHERE condition NOT IN ({_OFF})", "fleet")
def _(t):
    return an.alerts(_scored_runs(t), t.as_of, _last_failures(t))


_SCHEDULES = ["*/30 * * * *", "0 * * * *", "0 */6 * * *", "@daily", "*/7 * * * *", "0 */5 * * *", "", "weekly"]
_INTERVALS = [30, 60, 360, 1440, 7, 300, None, None]


@query("a23_overdue", f"""WITH f AS (SELECT DISTINCT pipeline_name, user_id FROM fleet UNION ALL SELECT 'new_' || c_custkey, c_custkey FROM customer),
    s AS (SELECT pipeline_name, [{', '.join(lit(v) for v in _SCHEDULES)}][user_id % 8 + 1] AS schedule, [{', '.join(lit(v) for v in _INTERVALS)}][user_id % 8 + 1] AS interval_minutes FROM f),
    d AS (SELECT pipeline_name, max(completed_at) AS last_completed_at FROM fleet GROUP BY 1)
    SELECT s.pipeline_name, schedule, CAST(interval_minutes AS INTEGER) AS interval_minutes, last_completed_at FROM s LEFT JOIN d ON d.pipeline_name = s.pipeline_name
    WHERE interval_minutes IS NOT NULL AND (last_completed_at IS NULL OR epoch_us({AS_OF}) - epoch_us(last_completed_at) >= interval_minutes::BIGINT * 60000000)""", "fleet")
def _(t):
    flows = t.fleet.select("pipeline_name", "user_id").distinct().unionByName(
        t.customer.select(F.concat(F.lit("new_"), F.col("c_custkey").cast("string")).alias("pipeline_name"), F.col("c_custkey").alias("user_id")))
    flows = flows.select("pipeline_name", pick(_SCHEDULES, F.col("user_id") % 8).alias("schedule"))
    return an.overdue(flows, t.fleet, t.as_of)


@query("f19_remedy_choice", f"""WITH i AS (SELECT incident_id, pipeline_name, CASE WHEN outcome = 'rejected' THEN 'OTHER' ELSE anomaly_type END AS kind,
        lower(['mysql binlog moved', 'bq slot limit', 'type mismatch seen', 'null values', 'ssl timeout', 'nothing loaded', 'varchar cut'][incident_id % 7 + 1]) AS rc FROM incidents)
    SELECT incident_id, coalesce({case('kind', k.REMEDIATION_FOR)}, CASE {_REMEDY_WORDS} WHEN contains(pipeline_name, 'kafka') OR contains(pipeline_name, 'consumer') THEN 'cdc_lag' ELSE 'logic' END) AS remedy FROM i""", "incidents")
def _(t):
    causes = ["mysql binlog moved", "bq slot limit", "type mismatch seen", "null values", "ssl timeout", "nothing loaded", "varchar cut"]
    kind = F.when(F.col("outcome") == "rejected", "OTHER").otherwise(F.col("anomaly_type"))
    return t.incidents.select("incident_id", an.remedy_for(kind, pick(causes, F.col("incident_id") % 7), F.col("pipeline_name")).alias("remedy"))
