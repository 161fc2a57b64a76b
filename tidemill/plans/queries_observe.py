"""Queries: observability measures, insights and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.constants import INSIGHTS, SLA_SECONDS
from tidemill.functions.exprs import month_start, rnd
from tidemill.operators import insights as ins
from tidemill.operators import kpi
from tidemill.plans import marts, staging
from tidemill.plans.oracle import AS_OF, AVG, D, ORDERS_AS_OF, PCT, R, case, lit
from tidemill.plans.registry import query
from tidemill.sources.bindings import PIPELINES, RAW_TABLES

_SUCC = "status = 'success'"


@query("o01_records_loaded", f"SELECT CAST(coalesce(sum(records_loaded), 0) AS BIGINT) AS total_records_loaded FROM runs WHERE {_SUCC}", "runs")
def _(t):
    return kpi.records_loaded(t.runs)


@query("o02_daily_records", f"""SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, pipeline_name, CAST(sum(records_loaded) AS BIGINT) AS records,
    strftime(CAST(started_at AS DATE), '%b %d') AS date FROM runs WHERE started_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY CAST(started_at AS DATE), pipeline_name""", "runs")
def _(t):
    return kpi.daily_records(t.runs, t.as_of)


@query("o03_daily_incidents", f"""SELECT CAST(CAST(detection_at AS DATE) AS VARCHAR) AS day, count(*) AS incidents, strftime(CAST(detection_at AS DATE), '%b %d') AS date
    FROM incidents WHERE detection_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY CAST(detection_at AS DATE)""", "incidents")
def _(t):
    return kpi.daily_incidents(t.incidents, t.as_of)


_SLA = f"""SELECT pipeline_name, count(*) AS total_runs, {PCT(_SUCC)} AS success_rate, count(*) FILTER (WHERE duration_seconds > 300) AS sla_breaches,
    max(started_at) AS last_run_at, {R('quantile_cont(CAST(duration_seconds AS DOUBLE), 0.5)', 1)} AS p50_s, {R('quantile_cont(CAST(duration_seconds AS DOUBLE), 0.95)', 1)} AS p95_s
    FROM {{runs}} WHERE started_at >= {AS_OF} - INTERVAL 30 DAY AND duration_seconds IS NOT NULL GROUP BY 1"""


@query("o04_sla_by_flow", _SLA.format(runs="runs"), "runs")
def _(t):
    return kpi.sla_by_flow(t.runs, t.as_of)


@query("o04_sla_by_flow_fleet", _SLA.format(runs="fleet"), "fleet")
def _(t):
    return kpi.sla_by_flow(t.fleet, t.as_of)


@query("o04_sla_by_flow_approx")
def _(t):
    return kpi.sla_by_flow(t.runs, t.as_of, approx=True)


@query("o05_daily_errors", f"""SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, {PCT("status <> 'success'")} AS error_rate, count(*) AS total_runs,
    count(*) FILTER (WHERE status <> 'success') AS failed_runs, {R('quantile_cont(CAST(coalesce(duration_seconds, 0) AS DOUBLE), 0.95)', 1)} AS p95_s,
    strftime(CAST(started_at AS DATE), '%b %d') AS date FROM runs WHERE started_at >= {AS_OF} - INTERVAL 14 DAY GROUP BY CAST(started_at AS DATE)""", "runs")
def _(t):
    return kpi.daily_errors(t.runs, t.as_of)


@query("o06_overall_sla", f"""SELECT count(*) AS total_runs, {PCT(_SUCC, 2)} AS overall_success_rate, {R('quantile_cont(CAST(coalesce(duration_seconds, 0) AS DOUBLE), 0.5)', 1)} AS global_p50,
    {R('quantile_cont(CAST(coalesce(duration_seconds, 0) AS DOUBLE), 0.95)', 1)} AS global_p95, count(*) FILTER (WHERE duration_seconds > 300) AS total_sla_breaches
    FROM runs WHERE started_at >= {AS_OF} - INTERVAL 30 DAY""", "runs")
def _(t):
    return kpi.overall_sla(t.runs, t.as_of)


_STATS = f"""count(*) AS total_runs, CAST(coalesce(sum(records_loaded), 0) AS BIGINT) AS total_rows, {R(AVG('duration_seconds'), 1)} AS avg_duration_s,
    {PCT(_SUCC)} AS success_rate, max(started_at) AS last_run_at"""


@query("o07_run_stats", f"SELECT {_STATS} FROM runs", "runs")
def _(t):
    return kpi.run_stats(t.runs)


@query("o07_run_stats_by_flow", f"SELECT pipeline_name, {_STATS} FROM fleet GROUP BY 1", "fleet")
def _(t):
    return kpi.run_stats(t.fleet, ["pipeline_name"])


def _flows(t):
    return t.customer.select(
        F.concat_ws("_", F.element_at(F.array(*map(F.lit, PIPELINES)), (F.col("c_custkey") % 6 + 1).cast("int")), F.col("c_custkey").cast("string"))
        .alias("pipeline_name"), F.col("c_name").alias("owner"))


@query("o08_flows_with_last_run", f"""WITH p AS (SELECT [{', '.join(f"'{p}'" for p in PIPELINES)}][c_custkey % 6 + 1] || '_' || c_custkey AS pipeline_name, c_name AS owner FROM customer),
    l AS (SELECT *, row_number() OVER (PARTITION BY pipeline_name ORDER BY started_at DESC, run_no DESC) AS rn FROM fleet)
    SELECT p.pipeline_name, owner, run_no, status, records_loaded, started_at FROM p LEFT JOIN l ON l.pipeline_name = p.pipeline_name AND rn = 1""", "fleet")
def _(t):
    return kpi.flows_with_last_run(_flows(t), t.fleet)


@query("o09_incident_counts", """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending_approval') AS pending, count(*) FILTER (WHERE outcome = 'approved') AS approved,
    count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status IN ('auto_healed', 'resolved')) AS deployed FROM incidents""", "incidents")
def _(t):
    return kpi.incident_counts(t.incidents)


@query("o10_incident_page", """SELECT incident_id, detection_at, anomaly_type, (SELECT count(*) FROM incidents WHERE status = 'open') AS total,
    (SELECT count(*) FROM incidents WHERE status = 'open') > 60 AS has_more FROM incidents WHERE status = 'open'
    ORDER BY detection_at DESC, incident_id DESC LIMIT 20 OFFSET 40""", "incidents")
def _(t):
    return kpi.incident_page(t.incidents, "open", 20, 40).select("incident_id", "detection_at", "anomaly_type", "total", "has_more")


@query("o11_runs_chart", f"""SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day,
    {', '.join(f"CAST(sum(records_loaded) FILTER (WHERE pipeline_name = '{p}') AS BIGINT) AS {p}" for p in PIPELINES)}
    FROM runs WHERE started_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY CAST(started_at AS DATE)""", "runs")
def _(t):
    return kpi.runs_chart(t.runs, PIPELINES, t.as_of)


_HEALED = "status IN ('auto_healed', 'resolved') AND resolved_at IS NOT NULL"


@query("o12_recovery", f"""SELECT {R(f'''CAST(sum(CAST(greatest(epoch_us(resolved_at) - epoch_us(detection_at), 0) AS DECIMAL(20,0))) FILTER (WHERE {_HEALED}) AS DOUBLE)
    / 60000000.0::DOUBLE / count(*) FILTER (WHERE {_HEALED})''', 0)} AS mttr_minutes,
    count(*) FILTER (WHERE detection_at >= {AS_OF} - INTERVAL 24 HOUR) AS anomalies_24h FROM incidents""", "incidents")
def _(t):
    return kpi.recovery(t.incidents, t.as_of)


@query("o12_breakdown", f"SELECT replace(anomaly_type, '_', ' ') AS name, count(*) AS value FROM incidents WHERE detection_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1", "incidents")
def _(t):
    return kpi.breakdown(t.incidents, t.as_of)


@query("o13_mttr_improving", f"""WITH d AS (SELECT CAST(resolved_at AS DATE) AS date, {R(AVG('mttr_seconds'), 2)} AS v FROM incidents
        WHERE resolved_at >= {AS_OF} - INTERVAL 30 DAY AND mttr_seconds IS NOT NULL GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY date) AS a, row_number() OVER (ORDER BY date DESC) AS z, count(*) OVER () AS n FROM d),
    s AS (SELECT avg(v) FILTER (WHERE a <= 3) AS head, avg(v) FILTER (WHERE z <= 3) AS tail, max(v) FILTER (WHERE a = 1) AS f, max(v) FILTER (WHERE z = 1) AS l, max(n) AS n FROM r)
    SELECT coalesce(n >= 4 AND tail < head, FALSE) AS improving, CASE WHEN n >= 4 THEN {R('(f - l) / nullif(f, 0) * 100', 0)} END AS improvement_pct FROM s""", "incidents")
def _(t):
    from tidemill.operators.outcomes import mttr_trend
    return kpi.improving(mttr_trend(t.incidents, 30, t.as_of), "date", "avg_mttr_seconds")


@query("o14_sla_compliance", f"""WITH r AS (SELECT *, {case('pipeline_name', SLA_SECONDS, 3600)} AS sla_target FROM runs
        WHERE started_at >= {AS_OF} - INTERVAL 7 DAY AND completed_at IS NOT NULL)
    SELECT pipeline_name, sla_target, count(*) AS total_runs, count(*) FILTER (WHERE duration_seconds <= sla_target) AS within_sla,
    {PCT('duration_seconds <= sla_target')} AS compliance_pct, {R(AVG('duration_seconds'), 0)} AS avg_duration, {R('max(duration_seconds)', 0)} AS max_duration FROM r GROUP BY 1, 2""", "runs")
def _(t):
    return kpi.sla_compliance(t.runs, t.as_of)


@query("o15_upstream_health", f"""SELECT pipeline_name, count(*) FILTER (WHERE {_SUCC}) AS ok, count(*) FILTER (WHERE status = 'failed') AS failed FROM runs
    WHERE started_at >= {AS_OF} - INTERVAL 30 MINUTE GROUP BY 1""", "runs")
def _(t):
    return kpi.upstream_health(t.runs, t.as_of)


@query("o16_digest", f"""SELECT count(*) AS total, count(*) FILTER (WHERE {_SUCC}) AS success, count(*) FILTER (WHERE NOT {_SUCC}) AS failed,
    CAST(coalesce(sum(records_loaded), 0) AS BIGINT) AS total_rows
    FROM (SELECT * FROM runs WHERE started_at > {AS_OF} - INTERVAL 24 HOUR ORDER BY started_at DESC, run_no DESC LIMIT 20)""", "runs")
def _(t):
    return kpi.digest(t.runs, t.as_of)


@query("o17_deliveries", """SELECT event_id AS delivery_id, user_id AS report_id, ts AS sent_at, c_name AS report_name, c_mktsegment AS report_type
    FROM events JOIN customer ON user_id = c_custkey ORDER BY ts DESC, event_id DESC LIMIT 50""")
def _(t):
    sent = t.events.select(F.col("event_id").alias("delivery_id"), F.col("user_id").alias("report_id"), F.col("ts").alias("sent_at"))
    reports = t.customer.select(F.col("c_custkey").alias("report_id"), F.col("c_name").alias("report_name"), F.col("c_mktsegment").alias("report_type"))
    return kpi.deliveries(sent, reports, 50)


@query("o18_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in RAW_TABLES))
def _(t):
    from tidemill.sources.readers import catalog_listing
    return catalog_listing({n: t.raw(n) for n in RAW_TABLES}).select("table_name", "row_count")


# ---- insights --------------------------------------------------------------------------------

def _fct_trips(t):
    return marts.fct_trips(staging.stg_trips(t.taxi))


def _summary(t):
    return marts.fct_ecommerce_summary(staging.stg_orders(t.shop))


def _customers(t):
    return marts.dim_customers(staging.stg_orders(t.shop))


def _zones(t):
    return marts.dim_taxi_zones(staging.stg_trips(t.taxi))


_TODAY = f"CAST({AS_OF} AS DATE)"
_ODAY = f"CAST({ORDERS_AS_OF} AS DATE)"
_TRIPS1 = f"""SELECT count(*) AS total_trips, {R(AVG('total_amount'), 2)} AS avg_fare, {D('sum(total_amount)')} AS total_revenue,
    count(*) FILTER (WHERE is_airport_trip) AS airport_trips, {PCT('is_airport_trip')} AS airport_pct,
    count(*) FILTER (WHERE pickup_date >= {_TODAY} - 1) AS trips_24h, {D(f'sum(total_amount) FILTER (WHERE pickup_date >= {_TODAY} - 1)')} AS revenue_24h
    FROM fct_trips WHERE pickup_date >= {_TODAY} - 7"""
_REV = "CAST(total_revenue AS DECIMAL(18,2))"
_COMM1 = f"""SELECT {R(f'sum({_REV})', 2)} AS revenue, CAST(sum(order_count) AS BIGINT) AS orders, {R(AVG('CAST(avg_order_value AS DECIMAL(18,2))'), 2)} AS avg_order
    FROM fct_summary WHERE order_date >= {_ODAY} - 7"""


@query("i01_trip_stats", _TRIPS1, "fct_trips")
def _(t):
    return ins.trip_stats(_fct_trips(t), t.as_of)


@query("i02_peak_hours", f"SELECT pickup_hour, count(*) AS trips FROM fct_trips WHERE pickup_date >= {_TODAY} - 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "fct_trips")
def _(t):
    return ins.peak_hours(_fct_trips(t), t.as_of)


@query("i02_payment_split", f"SELECT payment_method, count(*) AS trips FROM fct_trips WHERE pickup_date >= {_TODAY} - 7 GROUP BY 1", "fct_trips")
def _(t):
    return ins.payment_split(_fct_trips(t), t.as_of)


@query("i03_commerce_totals", _COMM1, "fct_summary")
def _(t):
    return ins.commerce_totals(_summary(t), t.orders_as_of)


@query("i03_top_categories", f"""SELECT category, {R(f'sum({_REV})', 2)} AS revenue, CAST(sum(order_count) AS BIGINT) AS orders FROM fct_summary
    WHERE order_date >= {_ODAY} - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""", "fct_summary")
def _(t):
    return ins.top_categories(_summary(t), t.orders_as_of)


@query("i03_top_cities", f"SELECT city, {R(f'sum({_REV})', 2)} AS revenue FROM fct_summary WHERE order_date >= {_ODAY} - 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "fct_summary")
def _(t):
    return ins.top_cities(_summary(t), t.orders_as_of)


_LTV = R(AVG(_REV), 2)


@query("i04_segments", f"SELECT customer_segment, count(*) AS customers, {_LTV} AS avg_ltv FROM dim_customers GROUP BY 1", "dim_customers")
def _(t):
    return ins.segments(_customers(t))


@query("i04_ltv_summary", f"SELECT count(*) AS total_customers, {_LTV} AS avg_ltv, max(total_revenue) AS max_ltv FROM dim_customers", "dim_customers")
def _(t):
    return ins.ltv_summary(_customers(t))


@query("i05_tier_breakdown", "SELECT zone_tier, count(*) AS zones, CAST(sum(total_trips) AS BIGINT) AS trips FROM dim_zones GROUP BY 1", "dim_zones")
def _(t):
    return ins.tier_breakdown(_zones(t))


@query("i05_top_zones", "SELECT location_id, total_trips, avg_fare FROM dim_zones ORDER BY total_trips DESC, location_id LIMIT 5", "dim_zones")
def _(t):
    return ins.top_zones(_zones(t))


@query("i06_run_health", f"""SELECT pipeline_name, status, count(*) AS runs, max(started_at) AS last_run FROM runs
    WHERE started_at >= {AS_OF} - INTERVAL 24 HOUR GROUP BY 1, 2""", "runs")
def _(t):
    return ins.run_health(t.runs, t.as_of)


@query("i07_drill_trips", f"""SELECT CAST(pickup_date AS VARCHAR) AS pickup_date, count(*) AS trips, {D('sum(total_amount)')} AS revenue FROM fct_trips
    WHERE pickup_date >= {_TODAY} - 30 GROUP BY 1 ORDER BY 1 DESC LIMIT 30""", "fct_trips")
def _(t):
    return ins.drill_down("trips", _fct_trips(t), "30d", t.as_of)


@query("i07_drill_commerce", f"""SELECT CAST(order_date AS VARCHAR) AS order_date, category, {R(f'sum({_REV})', 2)} AS revenue FROM fct_summary
    WHERE order_date >= {_ODAY} - 7 GROUP BY 1, 2 ORDER BY 1 DESC, 2 LIMIT 30""", "fct_summary")
def _(t):
    return ins.drill_down("ecommerce", _summary(t), "7d", t.orders_as_of)


@query("i07_drill_zones", f"""SELECT zone_tier, count(*) AS zones, CAST(sum(total_trips) AS BIGINT) AS total_trips, {R(AVG('CAST(avg_fare AS DECIMAL(18,2))'), 2)} AS avg_fare
    FROM dim_zones GROUP BY 1""", "dim_zones")
def _(t):
    return ins.drill_down("zones", _zones(t), "30d", t.as_of)


@query("i07_drill_customers", f"SELECT customer_segment, count(*) AS customers, {_LTV} AS avg_ltv FROM dim_customers GROUP BY 1", "dim_customers")
def _(t):
    return ins.drill_down("customers", _customers(t), "30d", t.as_of)


def _rounded(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,6)), {digits}) AS DECIMAL(18,{digits}))"


def _fmt(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


_SHOWN = {
    "rev": _fmt(_rounded("rev", 0)), "trips": _fmt("n"), "fare": f"CAST({_rounded('rev / greatest(n, 1)', 2)} AS VARCHAR)",
    "apt": f"CAST({_rounded('apt', 1)} AS VARCHAR)", "eco_rev": _fmt(_rounded("eco", 0)), "eco_ord": _fmt("orders"),
    "vip": "CAST(vip AS VARCHAR)", "vip_ltv": f"CAST({_rounded('vip_ltv', 2)} AS VARCHAR)",
}


def _filled(template: str) -> str:
    out = lit(template)
    for name, value in _SHOWN.items():
        if f"{{{name}}}" in template:
            out = f"replace({out}, '{{{name}}}', {value})"
    return out


_INSIGHT_ROWS = " UNION ALL ".join(
    f"""SELECT {_filled(title)} AS title, {_filled(insight)} AS insight,
        {"CASE WHEN apt > 10 THEN 'opportunity' ELSE 'info' END" if severity == "by_airport_share" else lit(severity)} AS severity,
        {_filled(metric)} AS metric, {lit(window)} AS time_window, {lit(table)} AS table_name FROM one"""
    for title, insight, severity, metric, window, table in INSIGHTS)


@query("i08_insight_rows", f"""WITH tr AS ({_TRIPS1}), co AS ({_COMM1}),
    vi AS (SELECT count(*) AS vip, coalesce({AVG(_REV)}, 0) AS vip_ltv FROM dim_customers WHERE customer_segment = 'VIP'),
    one AS (SELECT coalesce(total_revenue, 0) AS rev, total_trips AS n, coalesce(airport_pct, 0) AS apt, coalesce(revenue, 0) AS eco,
        coalesce(orders, 0) AS orders, vip, vip_ltv FROM tr, co, vi), rows AS ({_INSIGHT_ROWS})
    SELECT *, CASE severity WHEN 'anomaly' THEN 0 WHEN 'warning' THEN 1 WHEN 'opportunity' THEN 2 ELSE 3 END AS severity_rank FROM rows""", "fct_trips fct_summary dim_customers")
def _(t):
    return ins.insight_rows(ins.trip_stats(_fct_trips(t), t.as_of), ins.commerce_totals(_summary(t), t.orders_as_of), _customers(t))


@query("i08_cached_insights", f"""SELECT id AS title, started_at AS generated_at, CASE WHEN status = 'failed' THEN 1 ELSE 3 END AS severity_rank FROM runs
    WHERE started_at > {AS_OF} - INTERVAL 1 HOUR ORDER BY severity_rank, generated_at DESC, title LIMIT 10""", "runs")
def _(t):
    rows = t.runs.select(F.col("id").alias("title"), F.col("started_at").alias("generated_at"),
                         F.when(F.col("status") == "failed", 1).otherwise(3).alias("severity_rank"))
    return ins.cached_insights(rows, t.as_of)


@query("i09_failure_share", f"""SELECT pipeline_name, {PCT("status = 'failed'", 2)} AS failure_rate FROM fleet GROUP BY 1""", "fleet")
def _(t):
    return ins.failure_share(t.fleet)


@query("i09_slowest", f"SELECT pipeline_name, {R(AVG('duration_seconds'), 2)} AS avg_duration FROM fleet WHERE {_SUCC} GROUP BY 1", "fleet")
def _(t):
    return ins.slowest(t.fleet)


@query("i09_longest_runs", f"SELECT pipeline_name, id, {D('duration_seconds')} AS duration_seconds FROM runs ORDER BY runs.duration_seconds DESC, run_no LIMIT 5", "runs")
def _(t):
    return ins.longest_runs(t.runs)


def _totals_sql(key: str) -> str:
    return f"""SELECT {key}, count(*) AS orders, {D('sum(order_total)')} AS amount,
        {R('100.0 * (CAST(sum(order_total) AS DOUBLE) / CAST((SELECT sum(order_total) FROM shop_orders) AS DOUBLE))', 2)} AS share_pct FROM shop_orders GROUP BY 1"""


@query("i09_monthly_totals", _totals_sql("CAST(CAST(date_trunc('month', created_at) AS DATE) AS VARCHAR) AS month"), "shop_orders")
def _(t):
    return ins.totals_by(t.shop_orders.withColumn("month", month_start(F.col("created_at"))), ["month"], "order_total")


@query("i09_quarterly_totals", _totals_sql("CAST(extract(quarter FROM created_at) AS INTEGER) AS quarter"), "shop_orders")
def _(t):
    return ins.totals_by(t.shop_orders.withColumn("quarter", F.quarter("created_at")), ["quarter"], "order_total")


@query("i09_region_totals", _totals_sql("region"), "shop_orders")
def _(t):
    return ins.totals_by(t.shop_orders, ["region"], "order_total")


@query("i09_approvals_by_status", "SELECT status, count(*) AS incidents FROM incidents GROUP BY 1", "incidents")
def _(t):
    return t.incidents.groupBy("status").agg(F.count("*").alias("incidents"))


@query("i09_loaded_trend", f"""SELECT CAST(CAST(completed_at AS DATE) AS VARCHAR) AS date, CAST(sum(records_loaded) AS BIGINT) AS total FROM runs
    WHERE completed_at > {AS_OF} - INTERVAL 7 DAY GROUP BY 1""", "runs")
def _(t):
    recent = t.runs.filter(F.col("completed_at") > t.as_of - F.expr("INTERVAL '7' DAY"))
    return recent.groupBy(F.to_date("completed_at").alias("date")).agg(F.sum("records_loaded").alias("total"))


@query("i09_segment_payment_totals", f"""SELECT c_mktsegment AS segment, o_orderpriority AS payment, count(*) AS orders, {R('CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    # Totals per customer first, so the join meets one row per customer and payment.
    spent = t.orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("a"))
    return spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("payment")
    ).agg(F.sum("n").alias("orders"), rnd(F.sum("a"), 2).alias("amount"))
