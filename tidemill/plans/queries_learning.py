"""Queries: outcomes, learning, retrieval, experiment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.exprs import rnd
from tidemill.operators import outcomes as oc
from tidemill.operators import recall_index as ri
from tidemill.operators import retrieval as rt
from tidemill.operators import statistics as st
from tidemill.plans.oracle import AS_OF, AVG, R
from tidemill.plans.registry import query
from tidemill.session import cut_lineage

_OK = "outcome IN ('approved', 'auto_healed')"
_RATES = f"""rates AS (SELECT anomaly_type, healing_strategy, count(*) AS total, count(*) FILTER (WHERE {_OK}) AS successes,
    {R(f'count(*) FILTER (WHERE {_OK}) / CAST(count(*) AS DOUBLE)', 4)} AS success_rate,
    {R(f"coalesce({AVG('mttr_seconds')}, 0)", 2)} AS avg_mttr_seconds FROM incidents GROUP BY 1, 2)"""


@query("l01_strategy_rates", f"WITH {_RATES} SELECT * FROM rates", "incidents")
def _(t):
    return oc.strategy_rates(t.incidents)


@query("l02_best_strategy", f"""WITH {_RATES} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_type
    ORDER BY success_rate DESC, successes DESC, healing_strategy) AS rn FROM rates) WHERE rn = 1""", "incidents")
def _(t):
    return oc.best_strategy(oc.strategy_rates(t.incidents))


@query("l03_mttr_trend", f"""SELECT CAST(CAST(resolved_at AS DATE) AS VARCHAR) AS date, {R(AVG('mttr_seconds'), 2)} AS avg_mttr_seconds, count(*) AS incident_count
    FROM incidents WHERE resolved_at >= {AS_OF} - INTERVAL 30 DAY AND mttr_seconds IS NOT NULL GROUP BY 1""", "incidents")
def _(t):
    return oc.mttr_trend(t.incidents, 30, t.as_of)


@query("l04_totals", f"""SELECT count(*) AS total_outcomes, {R(f"coalesce({AVG('mttr_seconds')}, 0)", 2)} AS avg_mttr,
    {R(f'count(*) FILTER (WHERE {_OK}) / CAST(count(*) AS DOUBLE)', 4)} AS success_rate FROM incidents""", "incidents")
def _(t):
    return oc.totals(t.incidents)


@query("l05_top_anomalies", "SELECT anomaly_type, count(*) AS incidents FROM incidents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "incidents")
def _(t):
    return oc.top_anomalies(t.incidents)


@query("l06_weekly_improvement", f"""WITH w AS (SELECT coalesce(CAST(sum(mttr_seconds) FILTER (WHERE resolved_at >= a - INTERVAL 7 DAY) AS DOUBLE)
        / nullif(count(mttr_seconds) FILTER (WHERE resolved_at >= a - INTERVAL 7 DAY), 0), 0) AS w,
      coalesce(CAST(sum(mttr_seconds) FILTER (WHERE resolved_at >= a - INTERVAL 28 DAY AND resolved_at < a - INTERVAL 21 DAY) AS DOUBLE)
        / nullif(count(mttr_seconds) FILTER (WHERE resolved_at >= a - INTERVAL 28 DAY AND resolved_at < a - INTERVAL 21 DAY), 0), 0) AS b
      FROM incidents, (SELECT {AS_OF} AS a))
    SELECT {R('w', 2)} AS this_week, {R('b', 2)} AS four_weeks_ago, CASE WHEN b > 0 THEN {R('(b - w) / b * 100', 1)} ELSE 0.0::DOUBLE END AS weekly_improvement_pct FROM w""", "incidents")
def _(t):
    return oc.weekly_improvement(t.incidents, t.as_of)


_FIX = f"""fixes AS (SELECT fix_id, anomaly_type, count(*) FILTER (WHERE {_OK}) AS success_count, count(*) FILTER (WHERE outcome = 'rejected') AS failure_count,
    {AVG('mttr_seconds')} / 60.0::DOUBLE AS mttr_minutes, count(*) FILTER (WHERE outcome = 'rejected') >= 2 AS deprecated FROM incidents GROUP BY 1, 2),
    by_type AS (SELECT anomaly_type, {R('CAST(sum(CAST(coalesce(mttr_minutes, 0) AS DECIMAL(38,6))) AS DOUBLE) / count(*)', 1)} AS mttr_minutes
        FROM fixes WHERE NOT deprecated GROUP BY 1),
    succ0 AS (SELECT anomaly_type, sum(success_count) AS s, sum(success_count + failure_count) AS n FROM fixes GROUP BY 1),
    succ AS (SELECT anomaly_type, CAST(n AS BIGINT) AS total_fixes, {R('100.0::DOUBLE * (CAST(s AS DOUBLE) / CAST(n AS DOUBLE))', 1)} AS success_pct FROM
        (SELECT * FROM succ0 UNION ALL SELECT 'ALL', sum(s), sum(n) FROM succ0) WHERE n > 0)"""


@query("l07_mttr_by_anomaly", f"WITH {_FIX} SELECT * FROM by_type", "incidents")
def _(t):
    return oc.mttr_by_anomaly(oc.fix_library(t.incidents))


@query("l08_fix_success", f"WITH {_FIX} SELECT * FROM succ", "incidents")
def _(t):
    return oc.fix_success(oc.fix_library(t.incidents))


@query("l09_learned_threshold", f"""WITH {_FIX} SELECT anomaly_type, CASE WHEN count(*) < 3 THEN 0.75::DOUBLE ELSE least(0.95::DOUBLE, greatest(0.60::DOUBLE,
    {R('CAST(sum(CAST(0.60::DOUBLE + 0.35::DOUBLE * (success_count / CAST(success_count + failure_count AS DOUBLE)) AS DECIMAL(38,6))) AS DOUBLE) / count(*)', 3)})) END AS threshold,
    count(*) AS points FROM fixes WHERE NOT deprecated AND success_count + failure_count > 0 GROUP BY 1""", "incidents")
def _(t):
    return oc.learned_threshold(oc.fix_library(t.incidents))


_HALF = "TIMESTAMP '2024-01-16'"


@query("l10_deprecation", f"""SELECT fix_id, anomaly_type, count(*) FILTER (WHERE {_OK}) AS success_count, count(*) FILTER (WHERE outcome = 'rejected') AS failure_count,
    count(*) FILTER (WHERE outcome = 'rejected') >= 2 AS deprecated FROM incidents GROUP BY 1, 2 HAVING count(*) FILTER (WHERE detection_at < {_HALF}) > 0""", "incidents")
def _(t):
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    fixes = oc.fix_library(t.incidents.filter(F.col("detection_at") < half))
    return oc.apply_outcomes(fixes, t.incidents.filter(F.col("detection_at") >= half))


def _centroids(t):
    """One query vector per label: the mean of its vectors."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # 64 values per label, so the gathered array is bounded by the vector length.
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
        F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("embedding"), F.col("label").cast("string").alias("tag"))


def _store(t):
    return t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").cast("string").alias("tag"))


_CENT = """m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
    d AS (SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS item_id, e.label = c.label AS same,
        1.0::DOUBLE - list_dot_product(v, CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS distance
        FROM c CROSS JOIN embeddings e)"""


def _near(cond: str) -> str:
    return f"""near AS (SELECT * EXCLUDE same FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), item_id) AS INTEGER) AS rank
        FROM d WHERE {cond}) WHERE rank <= 3)"""


def _shown(df):
    return df.select("query_id", "item_id", rnd(F.col("distance"), 6).alias("distance"), "rank")


@query("l11_recall_filtered", f"WITH {_CENT}, {_near('same AND distance <= 0.9')} SELECT query_id, item_id, {R('distance', 6)} AS distance, rank FROM near")
def _(t):
    return _shown(rt.recall(_centroids(t), _store(t), max_distance=0.9))


@query("l11_recall_unfiltered", f"WITH {_CENT}, {_near('distance <= 0.9')} SELECT query_id, item_id, {R('distance', 6)} AS distance, rank FROM near")
def _(t):
    return _shown(rt.recall(_centroids(t).withColumn("tag", F.lit(None)), _store(t), max_distance=0.9))


@query("l11_recall_in_blocks", f"WITH {_CENT}, {_near('same AND distance <= 0.9')} SELECT query_id, item_id, {R('distance', 6)} AS distance, rank FROM near")
def _(t):
    return _shown(rt.recall(_centroids(t), _store(t), max_distance=0.9, max_queries=4, block_rows=300))


@query("l11_recall_skips_deprecated", f"WITH {_CENT}, {_near('same AND distance <= 0.9 AND item_id % 7 <> 0')} SELECT query_id, item_id, {R('distance', 6)} AS distance, rank FROM near")
def _(t):
    store = _store(t).withColumn("deprecated", F.col("item_id") % 7 == 0)
    return _shown(rt.recall(_centroids(t), store, max_distance=0.9))


def _indexed(t, k: int, whole: bool = False):
    """Vectors with an id divisible by 100 against all rows, by the index; ``whole`` reads all lists."""
    centres, probes = ri.fit(_store(t), k=k)
    index = cut_lineage(ri.build(_store(t), centres), "index")
    queries = _store(t).filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), "embedding", F.lit(None).alias("tag"))
    return queries, ri.search(queries, index, centres, len(centres) if whole else probes, k)


@query("l11_index_recall", """SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS queries, 10 * count(*) FILTER (WHERE vec_id % 100 = 0) AS neighbours,
    true AS reaches_90_pct FROM embeddings WHERE embedding IS NOT NULL""")
def _(t):
    queries, found = _indexed(t, 10)
    exact = rt.recall(queries, _store(t), 10, 2.0)
    return ri.measured_recall(found, exact).select("queries", "neighbours", (F.col("recall") >= 0.9).alias("reaches_90_pct"))


@query("l11_index_all_lists", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
    d AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, 1.0::DOUBLE - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS distance
          FROM v a CROSS JOIN v b WHERE a.vec_id % 100 = 0)
    SELECT query_id, item_id, {R('distance', 6)} AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), item_id) AS rank FROM d) WHERE rank <= 3""")
def _(t):
    return _shown(_indexed(t, 3, True)[1])


@query("l12_similar_queries", f"""WITH {_CENT}, {_near('distance < 0.9')}, s AS (SELECT query_id, item_id, {R('1 - distance', 3)} AS similarity,
    CAST(item_id % 11 AS DOUBLE) / 10.0::DOUBLE AS quality_score FROM near)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY quality_score DESC, item_id) AS INTEGER) AS position FROM s""")
def _(t):
    near = rt.recall(_centroids(t).withColumn("tag", F.lit(None)), _store(t), max_distance=0.9)
    quality = t.embeddings.select(F.col("vec_id").alias("item_id"), ((F.col("vec_id") % 11) / F.lit(10.0)).alias("quality_score"))
    return rt.similar_queries(near, quality)


@query("l13_reuse_gate", f"WITH {_CENT}, {_near('same AND distance <= 0.9')} SELECT query_id, item_id, {R('distance', 6)} AS distance, rank FROM near WHERE rank = 1 AND 1 - distance >= 0.3")
def _(t):
    return _shown(rt.reusable(rt.recall(_centroids(t), _store(t), max_distance=0.9), 0.3))


@query("l14_query_quality", f"""SELECT query_id, {R('greatest(0.0, least(1.0, 0.5::DOUBLE + CASE WHEN rows_returned > 0 THEN 0.2 ELSE 0 END + CASE WHEN execution_ms < 2000 THEN 0.1 WHEN execution_ms > 10000 THEN -0.1 ELSE 0 END + feedback * 0.2))', 3)} AS quality_score
    FROM query_log""", "query_log")
def _(t):
    return t.query_log.select("query_id", oc.query_quality(F.col("rows_returned"), F.col("execution_ms"), F.col("feedback")).alias("quality_score"))


@query("l15_derive_outcome", f"""SELECT incident_id, (epoch_us({AS_OF}) - epoch_us(detection_at)) / 1000000.0::DOUBLE AS mttr_seconds, left(sha256(fix_id), 16) AS fix_code_hash FROM incidents""", "incidents")
def _(t):
    return oc.derive_outcome(t.incidents.withColumn("now", t.as_of), "fix_id", F.col("now")).select(
        "incident_id", F.col("mttr_seconds").cast("double").alias("mttr_seconds"), "fix_code_hash")


@query("l16_summary", f"""WITH {_FIX} SELECT anomaly_type, success_pct, (SELECT {R('CAST(sum(CAST(mttr_minutes AS DECIMAL(38,6))) AS DOUBLE) / count(*)', 1)} FROM by_type) AS avg_mttr_minutes
    FROM succ WHERE anomaly_type <> 'ALL' ORDER BY success_pct DESC, anomaly_type LIMIT 5""", "incidents")
def _(t):
    return oc.summary(oc.fix_library(t.incidents))


# ---- experiment statistics -------------------------------------------------------------------

@query("e01_describe", f"""SELECT anomaly_type, count(*) AS n, {R('avg(v)', 2)} AS mean, {R('stddev_samp(v)', 2)} AS std, {R('min(v)', 2)} AS min, {R('max(v)', 2)} AS max,
    {R('quantile_cont(v, 0.5)', 2)} AS median, {R('avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*))', 2)} AS ci95_low, {R('avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*))', 2)} AS ci95_high
    FROM (SELECT anomaly_type, CAST(mttr_seconds AS DOUBLE) AS v FROM incidents WHERE mttr_seconds IS NOT NULL) GROUP BY 1""", "incidents")
def _(t):
    return st.describe(t.incidents, ["anomaly_type"], "mttr_seconds")


_PAIRS = """pairs AS (SELECT a.user_id, a.event_type, a.v AS x, b.v AS y FROM u a JOIN u2 b ON a.user_id = b.user_id AND a.event_type = b.event_type)"""
_PAIR_SRC = f"""u AS (SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM events WHERE ts < {_HALF} GROUP BY 1, 2),
    u2 AS (SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM events WHERE ts >= {_HALF} GROUP BY 1, 2), {_PAIRS}"""


def _pairs(t):
    """Mean value per user and event type before and after mid-month."""
    half = F.lit("2024-01-16").cast("timestamp_ntz")

    def side(rows, name):
        v = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")
        return rows.groupBy("user_id", "event_type").agg(v.alias(name))

    return side(t.events.filter(F.col("ts") < half), "x").join(side(t.events.filter(F.col("ts") >= half), "y"), ["user_id", "event_type"])


@query("e02_paired_t", f"""WITH {_PAIR_SRC}, s AS (SELECT event_type, count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS sd FROM pairs GROUP BY 1)
    SELECT event_type, n, n - 1 AS df, {R('m / (sd / sqrt(n))', 4)} AS t_statistic, {R('m / sd', 4)} AS cohens_d FROM s""")
def _(t):
    return st.paired_t(_pairs(t), "x", "y", ["event_type"])


@query("e03_one_sample_t", f"""SELECT event_type, count(*) AS n, count(*) - 1 AS df, {R('(avg(value) - 50) / (stddev_samp(value) / sqrt(count(*)))', 4)} AS t_statistic FROM events GROUP BY 1""")
def _(t):
    return st.one_sample_t(t.events, "value", 50.0, ["event_type"])


@query("e04_reduction", f"""WITH {_PAIR_SRC}, s AS (SELECT event_type, avg(x) AS a, avg(y) AS b FROM pairs GROUP BY 1)
    SELECT event_type, {R('100.0 * ((a - b) / a)', 2)} AS reduction_pct, {R('a / b', 2)} AS speedup FROM s""")
def _(t):
    means = _pairs(t).groupBy("event_type").agg(F.avg("x").alias("a"), F.avg("y").alias("b"))
    pct, speedup = st.reduction(F.col("a"), F.col("b"))
    return means.select("event_type", pct.alias("reduction_pct"), speedup.alias("speedup"))


@query("e05_learning_curve", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY anomaly_type ORDER BY detection_at, incident_id) AS rn FROM incidents)
    SELECT anomaly_type, (rn - 1) // 5 AS block, count(*) AS n, {R(AVG('mttr_seconds'), 1)} AS mean_value,
    {R(f'count(*) FILTER (WHERE {_OK}) / CAST(count(*) AS DOUBLE)', 3)} AS success_rate FROM r GROUP BY 1, 2""", "incidents")
def _(t):
    return st.learning_curve(t.incidents, ["anomaly_type"], "detection_at", "incident_id", "mttr_seconds",
                             F.col("outcome").isin(oc.SUCCESS))


def _rate(strategy: str) -> str:
    cond = f"healing_strategy = '{strategy}'"
    return f"{R(f'count(*) FILTER (WHERE {_OK} AND {cond}) / nullif(CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE), 0)', 3)} AS {strategy}"


@query("e06_success_by_configuration", f"SELECT anomaly_type, {_rate('retry')}, {_rate('rollback')}, {_rate('schema_patch')} FROM incidents GROUP BY 1", "incidents")
def _(t):
    return st.success_by_configuration(t.incidents, "anomaly_type", "healing_strategy", ["retry", "rollback", "schema_patch"],
                                       F.col("outcome").isin(oc.SUCCESS))
