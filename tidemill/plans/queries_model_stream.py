"""Queries: run models, lineage, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import constants as k
from tidemill.functions.exprs import rnd
from tidemill.operators import anomalies as an
from tidemill.operators import isolation_forest as iso
from tidemill.operators import lineage as ln
from tidemill.operators import run_model as rm
from tidemill.plans.oracle import AVG, D, R, RUN_RULES, arr, lit
from tidemill.plans.queries_anomalies import _findings
from tidemill.plans.registry import query
from tidemill.session import scratch_path
from tidemill.sources.readers import spread
from tidemill.streaming import jobs, stalls

# ---- run models ------------------------------------------------------------------------------

_FEATURES = """feats AS (SELECT run_no, pipeline_name, status, error_message, CAST(coalesce(records_loaded, 0) AS DOUBLE) AS records_loaded,
    CAST(coalesce(records_failed, 0) AS DOUBLE) AS records_failed, CAST(coalesce(records_ingested, 0) AS DOUBLE) AS records_ingested,
    CAST(coalesce(duration_seconds, 0) AS DOUBLE) AS duration_seconds,
    CAST(CASE WHEN extract(hour FROM started_at) = 0 THEN 9 ELSE extract(hour FROM started_at) END AS DOUBLE) AS hour_of_day,
    CAST(extract(dow FROM started_at) AS DOUBLE) AS day_of_week, CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS success_flag,
    CASE WHEN records_loaded > 0 THEN CAST(records_failed AS DOUBLE) / records_loaded ELSE 0.0::DOUBLE END AS fail_rate FROM runs)"""


@query("x01_detector_features", f"WITH {_FEATURES} SELECT * FROM feats", "runs")
def _(t):
    return rm.detector_features(t.runs)


_MEASURES = {"loaded": "coalesce(records_loaded, records_ingested, 0)", "duration": "duration_seconds", "failed": "coalesce(records_failed, 0)"}
_LABEL = " ".join(f"WHEN {_MEASURES[m]} {op} {bound} THEN {lit(name)}" for name, m, op, bound in k.WEAK_LABELS)
_TRAIN_COLUMNS = {
    "records_loaded": D(_MEASURES["loaded"]), "records_failed": D(_MEASURES["failed"]),
    "duration_seconds": D(f"coalesce(duration_seconds, {k.DEFAULT_TRAINING_SECONDS})"),
    "hour_of_day": D("extract(hour FROM started_at)"), "day_of_week": D("extract(dow FROM started_at)"),
    "source_code": D(f"greatest(coalesce(list_position({arr(rm.SOURCE_CODES)}, source_type), 1) - 1, 0)"),
    "success_flag": D("(status IS NOT DISTINCT FROM 'success')::INTEGER"),
    "label": f"CASE WHEN status IS DISTINCT FROM 'failed' THEN {lit(k.NO_FAILURE)} {_LABEL} ELSE {lit(k.OTHER_FAILURE)} END",
}
_TRAIN = f"train AS (SELECT run_no, {', '.join(f'{e} AS {c}' for c, e in _TRAIN_COLUMNS.items())} FROM {{src}})"
# Failed runs of the binding load nothing; these runs load half of what they read, so that every label occurs.
_HALF_RUNS = "half AS (SELECT * REPLACE (CASE WHEN status = 'failed' THEN records_ingested // 2 ELSE records_loaded END AS records_loaded) FROM runs)"


def _half_runs(t):
    half = F.floor(F.col("records_ingested") / 2)
    return t.runs.withColumn("records_loaded", F.when(F.col("status") == "failed", half).otherwise(F.col("records_loaded")))


@query("x02_training_set", f"WITH {_HALF_RUNS}, {_TRAIN.format(src='half')} SELECT * FROM train", "runs")
def _(t):
    return rm.training_set(_half_runs(t))


_SCALED = ["records_loaded", "records_failed", "duration_seconds"]


@query("x03_scaled_features", f"""WITH {_HALF_RUNS}, {_TRAIN.format(src='half')}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALED)} FROM train)
    SELECT run_no, {', '.join(R(f'({c} - m_{c}) / s_{c}', 4) + f' AS {c}' for c in _SCALED)} FROM train, s""", "runs")
def _(t):
    scaled = rm.scale(rm.training_set(_half_runs(t)), _SCALED)
    return scaled.select("run_no", *[rnd(F.col(c), 4).alias(c) for c in _SCALED])


def _scored(t):
    feats = rm.scale(spread(rm.detector_features(t.runs)), rm.DETECTOR_FEATURES)
    forest = iso.fit(feats, rm.DETECTOR_FEATURES, "run_no")
    return iso.decide(iso.score(forest, feats, "run_no"))


@query("x04_isolation_forest")
def _(t):
    return _scored(t)


@query("x04_forest_properties", "SELECT count(*) AS rows, count(DISTINCT run_no) AS runs, true AS share_is_contamination, true AS below_zero_are_outliers FROM runs", "runs")
def _(t):
    share = F.count_if("is_outlier") / F.count("*")
    return _scored(t).agg(
        F.count("*").alias("rows"), F.count_distinct("run_no").alias("runs"),
        # Equal scores at the border stay inside, so a little less than the share may be outside.
        ((share <= iso.CONTAMINATION + 0.001) & (share >= iso.CONTAMINATION - 0.02)).alias("share_is_contamination"),
        F.bool_and(F.col("is_outlier") == (F.col("decision") < 0)).alias("below_zero_are_outliers"))


@query("x05_balanced_training_set", f"""WITH {_HALF_RUNS}, {_TRAIN.format(src='half')}, c AS (SELECT count(*) FILTER (WHERE label <> 'NORMAL') AS a, count(*) FILTER (WHERE label = 'NORMAL') AS n FROM train)
    SELECT a AS anomalies, least(a, n) AS normals FROM c""", "runs")
def _(t):
    both = rm.balance(rm.training_set(_half_runs(t)))
    return both.agg(F.count_if(F.col("label") != "NORMAL").alias("anomalies"), F.count_if(F.col("label") == "NORMAL").alias("normals"))


@query("x06_stratified_split", f"""WITH {_HALF_RUNS}, {_TRAIN.format(src='half')},
    b AS (SELECT label, CAST('0x' || substr(md5(label || '|' || run_no), 1, 8) AS BIGINT) % 10000 < 7500 AS first FROM train)
    SELECT label, count(*) FILTER (WHERE first) AS train, count(*) FILTER (WHERE NOT first) AS test, {R('count(*) FILTER (WHERE first) / CAST(count(*) AS DOUBLE)', 2)} AS train_share
    FROM b GROUP BY 1""", "runs")
def _(t):
    train, test = rm.split(rm.training_set(_half_runs(t)))
    n = train.groupBy("label").agg(F.count("*").alias("train")).join(test.groupBy("label").agg(F.count("*").alias("test")), "label")
    return n.withColumn("train_share", rnd(F.col("train") / (F.col("train") + F.col("test")), 2))


@query("x07_classifier")
def _(t):
    train, test = rm.split(rm.balance(rm.training_set(_half_runs(t))))
    return rm.class_scores(rm.predict(rm.fit_classifier(train), test))


@query("x08_confidence")
def _(t):
    train, test = rm.split(rm.balance(rm.training_set(_half_runs(t))))
    return rm.predict(rm.fit_classifier(train), test).select("run_no", "label", "predicted", "confidence")


@query("x08_classifier_properties", f"""WITH {_HALF_RUNS}, {_TRAIN.format(src='half')},
    b AS (SELECT label FROM train WHERE CAST('0x' || substr(md5(label || '|' || run_no), 1, 8) AS BIGINT) % 10000 >= 7500)
    SELECT count(*) AS rows, count(DISTINCT label) AS labels, true AS accurate, true AS confident, true AS known_types FROM b""", "runs")
def _(t):
    train, test = rm.split(rm.training_set(_half_runs(t)))
    scored = rm.predict(rm.fit_classifier(train), test)
    seen = train.agg(F.collect_set("label")).scalar()
    return scored.agg(
        F.count("*").alias("rows"), F.count_distinct("label").alias("labels"),
        (F.count_if(F.col("label") == F.col("predicted")) / F.count("*") >= 0.9).alias("accurate"),
        # The most likely of n types has at least the n-th part of the probability.
        F.bool_and(F.col("confidence").between(1.0 / 8, 1.0 + 1e-9)).alias("confident"),
        F.bool_and(F.array_contains(seen, F.col("predicted"))).alias("known_types"))


def _guess(t):
    """Predictions of a simple rule, so that the scores can be checked exactly."""
    train = rm.training_set(_half_runs(t))
    return train.withColumn("predicted", F.when(F.col("success_flag") == 1, "NORMAL").when(F.col("duration_seconds") > 500, "PIPELINE_DELAY").otherwise("NULL_SPIKE"))


_GUESS = f"{_HALF_RUNS}, {_TRAIN.format(src='half')}, g AS (SELECT *, CASE WHEN success_flag = 1 THEN 'NORMAL' WHEN duration_seconds > 500 THEN 'PIPELINE_DELAY' ELSE 'NULL_SPIKE' END AS predicted FROM train)"
_CLASS = f"""k AS (SELECT label AS class FROM g UNION SELECT predicted FROM g),
    m AS (SELECT class, (SELECT count(*) FROM g WHERE label = class) AS support, (SELECT count(*) FROM g WHERE predicted = class) AS claimed,
        (SELECT count(*) FROM g WHERE label = class AND predicted = class) AS hit FROM k),
    pr AS (SELECT class, support, coalesce(hit / nullif(CAST(claimed AS DOUBLE), 0), 0) AS p, coalesce(hit / nullif(CAST(support AS DOUBLE), 0), 0) AS r, hit FROM m),
    cs AS (SELECT class, support, {R('p', 4)} AS precision, {R('r', 4)} AS recall, {R('coalesce(2 * p * r / nullif(p + r, 0), 0)', 4)} AS f1, hit FROM pr)"""


@query("x09_class_scores", f"WITH {_GUESS}, {_CLASS} SELECT * EXCLUDE hit FROM cs", "runs")
def _(t):
    return rm.class_scores(_guess(t))


@query("x09_overall_scores", f"""WITH {_GUESS}, {_CLASS} SELECT (SELECT count(*) FROM g) AS n, {R('CAST(sum(hit) AS DOUBLE) / (SELECT count(*) FROM g)', 4)} AS accuracy,
    {R('CAST(sum(CAST(f1 AS DECIMAL(18,4)) * support) AS DOUBLE) / CAST(sum(support) AS DOUBLE)', 4)} AS weighted_f1 FROM cs""", "runs")
def _(t):
    return rm.overall_scores(_guess(t))


@query("x09_confusion", f"WITH {_GUESS} SELECT label, predicted, count(*) AS n FROM g GROUP BY 1, 2", "runs")
def _(t):
    return rm.confusion(_guess(t))


@query("x09_roc_auc", f"""WITH {_HALF_RUNS}, s AS (SELECT status = 'failed' AS pos, round(CAST(duration_seconds AS DOUBLE)) AS s FROM half),
    r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS mid FROM s)
    SELECT {R('(sum(mid) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0::DOUBLE) / (CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * count(*) FILTER (WHERE NOT pos))', 4)} AS roc_auc FROM r""", "runs")
def _(t):
    scored = t.runs.select((F.col("status") == "failed").alias("pos"), F.round(F.col("duration_seconds").cast("double")).alias("s"))
    return rm.roc_auc(scored, "pos", "s")


@query("x09_binary_scores", f"""WITH b AS (SELECT status = 'failed' AS pos, duration_seconds > 400 AS flag FROM runs),
    c AS (SELECT count(*) FILTER (WHERE pos AND flag) AS tp, count(*) FILTER (WHERE NOT pos AND flag) AS fp, count(*) FILTER (WHERE pos AND NOT flag) AS fn FROM b)
    SELECT {R('tp / CAST(tp + fp AS DOUBLE)', 4)} AS precision, {R('tp / CAST(tp + fn AS DOUBLE)', 4)} AS recall, {R('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)', 4)} AS f1 FROM c""", "runs")
def _(t):
    b = t.runs.select((F.col("status") == "failed").alias("pos"), (F.col("duration_seconds") > 400).alias("flag"))
    return rm.binary_scores(b, "pos", "flag")


def _typed_outliers(t, scored=None):
    train = rm.balance(rm.training_set(_half_runs(t)))
    model = rm.fit_classifier(train)
    predicted = rm.predict(model, rm.training_set(_half_runs(t))).select("run_no", "predicted", "confidence")
    runs = t.fleet.select("run_no", "pipeline_name", "error_message")
    scored = _scored(t) if scored is None else scored
    outliers = scored.filter("is_outlier").join(runs, "run_no").join(predicted, "run_no")
    return outliers.withColumn("anomaly_type", rm.anomaly_type(F.col("error_message"), F.col("predicted")))


@query("x10_outlier_types")
def _(t):
    return _typed_outliers(t).select("run_no", "pipeline_name", "decision", "confidence", "anomaly_type")


def _type_by_text():
    return F.when(F.length("error_message") > 0, an.classify_error(F.col("error_message")))


@query("x10_type_properties", "SELECT 0::BIGINT AS text_not_first, 0::BIGINT AS without_type, true AS once_each")
def _(t):
    texts = t.fleet.select("run_no", _type_by_text().alias("by_text"))
    return _typed_outliers(t).join(texts, "run_no").agg(
        F.count_if(F.col("by_text").isNotNull() & (F.col("anomaly_type") != F.col("by_text"))).alias("text_not_first"),
        F.count_if(F.col("anomaly_type").isNull() | (F.col("anomaly_type") == "NORMAL")).alias("without_type"),
        (F.count("*") == F.count_distinct("run_no")).alias("once_each"))


def _with_outliers(t, scored=None):
    newest = an.latest_run(t.fleet).select("run_no")
    return an.with_model_outliers(an.detect(t.fleet, t.as_of), _typed_outliers(t, scored).join(newest, "run_no", "left_semi"))


# Which runs are outliers has no SQL form; that the newest run of each flow is listed as its score says has one.
@query("a14_findings_beside_the_model", f"""WITH {_findings('fleet')} SELECT *, CAST(NULL AS BOOLEAN) AS as_scored FROM findings
    UNION ALL SELECT pipeline_name, run_no, 'model_outlier', 14, NULL, NULL, true FROM latest""", "fleet")
def _(t):
    scored = _scored(t)
    newest = an.latest_run(t.fleet).join(scored.select("run_no", "decision"), "run_no").groupBy("pipeline_name", "run_no").agg(
        F.min("decision").alias("decision"), F.max(_type_by_text()).alias("by_text"))
    return an.beside_scores(_with_outliers(t, scored), newest)


@query("a14_model_outliers")
def _(t):
    return _with_outliers(t)


# ---- lineage ---------------------------------------------------------------------------------

_MANIFEST = ('{{"sources":{{"source.shop.raw_{k}":{{"name":"raw_{k}","schema":"raw"}}}},"nodes":{{'
             '"model.shop.stg_{k}":{{"name":"stg_{k}","resource_type":"model","schema":"staging","depends_on":{{"nodes":["source.shop.raw_{k}","source.gone.x"]}}}},'
             '"model.shop.fct_{k}":{{"name":"fct_{k}","resource_type":"model","schema":"","depends_on":{{"nodes":["model.shop.stg_{k}","seed.shop.code_{k}"]}}}},'
             '"seed.shop.code_{k}":{{"name":"code_{k}","resource_type":"seed","schema":"x","depends_on":{{"nodes":[]}}}},'
             '"test.shop.t_{k}":{{"name":"t_{k}","resource_type":"test","schema":"x","depends_on":{{"nodes":["model.shop.fct_{k}"]}}}}}}}}')


def _manifests(t):
    """One small model manifest per customer."""
    text = F.replace(F.lit(_MANIFEST.format(k="@")), F.lit("@"), F.col("c_custkey").cast("string"))
    return t.customer.select(F.col("c_custkey").alias("tenant"), text.alias("manifest"))


_NODES = """nodes AS (SELECT c_custkey AS tenant, p || c_custkey AS id, n || c_custkey AS name, r AS resource_type, s AS schema, l AS layer FROM customer,
    (VALUES ('source.shop.raw_', 'raw_', 'source', 'raw', 'source'), ('model.shop.stg_', 'stg_', 'model', 'staging', 'staging'),
            ('model.shop.fct_', 'fct_', 'model', '', 'mart'), ('seed.shop.code_', 'code_', 'seed', 'x', 'raw')) v(p, n, r, s, l))"""
_EDGES = """edges AS (SELECT c_custkey AS tenant, a || c_custkey AS src, b || c_custkey AS dst FROM customer,
    (VALUES ('source.shop.raw_', 'model.shop.stg_'), ('model.shop.stg_', 'model.shop.fct_'), ('seed.shop.code_', 'model.shop.fct_')) v(a, b))"""


@query("g01_manifest_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def _(t):
    return ln.manifest_nodes(_manifests(t), "manifest", ["tenant"])


@query("g02_manifest_edges", f"WITH {_EDGES} SELECT * FROM edges")
def _(t):
    return ln.manifest_edges(_manifests(t), "manifest", ["tenant"])


@query("g03_neighbours", """SELECT c_custkey AS tenant, n || c_custkey AS name, d AS direction, o || c_custkey AS neighbour FROM customer,
    (VALUES ('stg_', 'upstream', 'raw_'), ('fct_', 'upstream', 'stg_'), ('fct_', 'upstream', 'code_'), ('raw_', 'downstream', 'stg_'),
            ('stg_', 'downstream', 'fct_'), ('code_', 'downstream', 'fct_')) v(n, d, o)""")
def _(t):
    m = _manifests(t)
    return ln.neighbours(ln.manifest_nodes(m, "manifest", ["tenant"]), ln.manifest_edges(m, "manifest", ["tenant"]), ["tenant"])


_CODES = ["SELECT id AS order_id, total FROM raw_orders", "SELECT total, status FROM raw_orders", "WITH x AS (y) TABLE total", ""]


@query("g04_column_mappings", """SELECT c_custkey AS model, s AS source_col, d AS dest_col, tr AS transform FROM customer JOIN (VALUES
    (0, 'id', 'order_id', 'alias'), (0, 'total', 'total', 'passthrough'), (1, 'total', 'total', 'passthrough'), (1, 'status', 'status', 'passthrough'),
    (2, 'total', 'total', 'inferred'), (3, 'total', 'total', 'passthrough'), (3, 'status', 'status', 'passthrough')) v(shape, s, d, tr) ON c_custkey % 4 = shape""")
def _(t):
    models = t.customer.select(
        F.col("c_custkey").alias("model"),
        F.element_at(F.array(*map(F.lit, _CODES)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("raw_code"),
        F.array(*map(F.lit, ["id", "total", "status"])).alias("source_columns"),
        F.array(*map(F.lit, ["order_id", "total", "status"])).alias("dest_columns"))
    return ln.column_mappings(models, "model")


@query("g05_blast_radius", """WITH reach AS (SELECT 'region:' || r_regionkey AS seed, 'region:' || r_regionkey AS node, 0 AS depth FROM region
        UNION SELECT seed, dst, depth + 1 FROM reach JOIN lineage_edges ON node = src),
    d AS (SELECT seed, node, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY 1, 2)
    SELECT seed, CAST(depth AS INTEGER) AS depth, count(*) AS nodes FROM d GROUP BY 1, 2""", "lineage_edges")
def _(t):
    seeds = t.region.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("seed"))
    return ln.blast_radius(seeds, t.lineage_edges)


# ---- streaming -------------------------------------------------------------------------------

def _land(df, spark, label: str, parts: int = 6):
    """Write a table as several files for a file stream."""
    path = scratch_path(spark, label)
    df.repartition(parts).write.parquet(path)
    return path


@query("z01_incremental_stream", "SELECT event_type, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _(t):
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    landing, target, mark = (scratch_path(t.spark, n) for n in ("landing", "loaded", "mark"))
    t.events.filter(F.col("ts") < half).repartition(3).write.parquet(landing)
    jobs.start_incremental(jobs.file_stream(t.spark, landing, t.events.schema), target, mark).awaitTermination()
    t.events.filter(F.col("ts") >= half).repartition(3).write.mode("append").parquet(landing)
    jobs.start_incremental(jobs.file_stream(t.spark, landing, t.events.schema), target, mark).awaitTermination()
    return t.spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_LIVE = """SELECT "offset", key, op, event_time, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_time DESC, "offset" DESC) AS rn FROM changes) WHERE rn = 1 AND op <> 'DELETE'"""


@query("z02_apply_changes", _LIVE, "changes")
def _(t):
    return jobs.apply_changes(t.changes, ["key"], ["event_time", "offset"])


@query("z02_apply_changes_stream", _LIVE, "changes")
def _(t):
    landing, mark = _land(t.changes, t.spark, "changes"), scratch_path(t.spark, "mark")
    source = jobs.file_stream(t.spark, landing, t.changes.schema, files_per_batch=2)
    jobs.start_change_application(source, ["key"], ["event_time", "offset"], mark).awaitTermination()
    return jobs.changed_table(t.spark, mark).select(t.changes.columns)


@query("z03_deduplicate_stream", "SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def _(t):
    # Every event is delivered twice.
    slim = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    landing = _land(slim.unionByName(slim), t.spark, "twice")
    target = scratch_path(t.spark, "unique")
    jobs.start_deduplication(jobs.file_stream(t.spark, landing, slim.schema), ["event_id"], "ts", "40 days", target, scratch_path(t.spark, "mark")).awaitTermination()
    return t.spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"))


@query("z04_run_monitor_stream", f"""WITH b AS (SELECT pipeline_name, {AVG('records_loaded')} AS al FROM runs WHERE status = 'success' GROUP BY 1) {RUN_RULES}""", "runs")
def _(t):
    slim = t.runs.select("run_no", "pipeline_name", "started_at", "status", "error_message", "records_loaded", "duration_seconds")
    baseline = slim.filter("status = 'success'").groupBy("pipeline_name").agg((F.sum("records_loaded").cast("double") / F.count("*")).alias("avg_loaded"))
    landing, target = _land(slim, t.spark, "runs"), scratch_path(t.spark, "findings")
    jobs.start_run_monitor(jobs.file_stream(t.spark, landing, slim.schema, 2), target, scratch_path(t.spark, "mark"), baseline).awaitTermination()
    return t.spark.read.parquet(target).drop("batch")


@query("z05_late_rows", """SELECT event_type, ts < TIMESTAMP '2024-01-16' AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 DAY AS is_late, count(*) AS rows FROM events GROUP BY 1, 2""")
def _(t):
    landing, target = scratch_path(t.spark, "days"), scratch_path(t.spark, "split")
    # Two deliveries of several files: the second half of the month first, then the first half. Each is one batch.
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    mark = scratch_path(t.spark, "mark")
    for part in (t.events.filter(F.col("ts") >= half), t.events.filter(F.col("ts") < half)):
        part.repartition(4).write.mode("append").parquet(landing)
        jobs.start_late_split(jobs.file_stream(t.spark, landing, t.events.schema), "ts", "2 days", target, mark).awaitTermination()
    return t.spark.read.parquet(target).groupBy("event_type", F.col("is_late").cast("boolean").alias("is_late")).agg(F.count("*").alias("rows"))


_HOURLY = f"""SELECT pipeline_name, engine, date_trunc('hour', recorded_at) AS window_start, count(*) AS samples, max(consumer_lag) AS max_lag, max(watermark_lag_ms) AS max_watermark_lag_ms,
    {R(AVG('micro_batch_ms'), 2)} AS avg_batch_ms, {R(AVG('records_per_second'), 2)} AS avg_records_per_second FROM stream_metrics GROUP BY 1, 2, 3"""


@query("z06_hourly_rollup", _HOURLY, "stream_metrics")
def _(t):
    return jobs.rollup(t.stream_metrics, "1 hour")


@query("z06_hourly_rollup_stream", f"SELECT * FROM ({_HOURLY}) WHERE window_start + INTERVAL 3 HOUR <= (SELECT max(recorded_at) FROM stream_metrics)", "stream_metrics")
def _(t):
    # Windows that the watermark, two hours behind the newest row, has passed.
    rows = t.stream_metrics.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    landing, target = _land(rows, t.spark, "metrics"), scratch_path(t.spark, "hours")
    source = jobs.file_stream(t.spark, landing, rows.schema)
    jobs.start_rollup(source, "1 hour", "2 hours", target, scratch_path(t.spark, "mark")).awaitTermination()
    hours = t.spark.read.parquet(target)
    return hours.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_FOLLOWED = """SELECT a.event_id AS first_event_id, b.event_id AS second_event_id, a.user_id, epoch_us(b.ts) - epoch_us(a.ts) AS gap_us
    FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
    WHERE a.event_type = 'view' AND b.event_type = 'purchase'"""


def _views_and_purchases(events):
    slim = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return [slim.filter(F.col("event_type") == kind).drop("event_type") for kind in ("view", "purchase")]


def _gaps(pairs):
    return pairs.select("first_event_id", "second_event_id", F.col("first_user_id").alias("user_id"),
                        (F.unix_micros("second_ts") - F.unix_micros("first_ts")).alias("gap_us"))


@query("w12_followed_within", _FOLLOWED)
def _(t):
    return _gaps(jobs.followed_within(*_views_and_purchases(t.events), ["user_id"], "ts", 6 * 3600))


@query("w12_followed_within_stream", _FOLLOWED)
def _(t):
    landing, target = _land(t.events, t.spark, "events"), scratch_path(t.spark, "pairs")
    views, purchases = _views_and_purchases(jobs.file_stream(t.spark, landing, t.events.schema, 2))
    # The files are not in time order, so rows may come as late as the table is long.
    jobs.start_followed_within(views, purchases, ["user_id"], "ts", 6 * 3600, "40 days", target, scratch_path(t.spark, "mark")).awaitTermination()
    return _gaps(t.spark.read.parquet(target))


_STALLS = """WITH g AS (SELECT pipeline_name, recorded_at, lead(recorded_at) OVER (PARTITION BY pipeline_name ORDER BY recorded_at) AS next_at,
        max(recorded_at) OVER () AS until FROM stream_metrics)
    SELECT DISTINCT pipeline_name, recorded_at AS last_at FROM g WHERE coalesce(next_at, until) - recorded_at > INTERVAL 3 HOUR"""


@query("z05_stalled_sources", _STALLS, "stream_metrics")
def _(t):
    until = t.stream_metrics.agg(F.max("recorded_at")).scalar()
    return stalls.stalls(t.stream_metrics, "pipeline_name", "recorded_at", "engine", 3 * 3600, until)


@query("z05_stalled_sources_stream", _STALLS, "stream_metrics")
def _(t):
    # Three deliveries in time order, of several files each; the query stops between them and goes on from its checkpoint.
    landing, target, mark = (scratch_path(t.spark, n) for n in ("metrics", "stalls", "mark"))
    day = F.dayofmonth("recorded_at")
    for first, last in ((1, 9), (10, 19), (20, 31)):
        t.stream_metrics.select("pipeline_name", "recorded_at").filter(day.between(first, last)).repartition(3).write.mode("append").parquet(landing)
        source = jobs.file_stream(t.spark, landing, "pipeline_name string, recorded_at timestamp_ntz")
        stalls.start_stall_watch(source, "pipeline_name", "recorded_at", 3 * 3600, "0 seconds", target, mark).awaitTermination()
    return t.spark.read.parquet(target).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
