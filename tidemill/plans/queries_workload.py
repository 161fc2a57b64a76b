"""Queries: the analyst workload and the window, sort and set capabilities."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import exprs as x
from tidemill.functions import series as sr
from tidemill.functions.ordered import exact_percentiles, with_running_sum
from tidemill.operators import workload as wl
from tidemill.plans import staging
from tidemill.plans.oracle import AS_OF, AVG, D, ORDERS_AS_OF, PCT, R
from tidemill.plans.registry import query
from tidemill.session import scratch_path
from tidemill.sources.sinks import bucket_count, write_bucketed


def _trips(t):
    return staging.stg_trips(t.taxi)


@query("w01_scalar_totals", f"""SELECT count(*) AS rows, {D('sum(total_amount)')} AS total, {R(AVG('total_amount'), 2)} AS mean, {D('min(total_amount)')} AS low,
    {D('max(total_amount)')} AS high, count(*) FILTER (WHERE payment_method = 'Cash') AS matching FROM stg_trips""", "stg_trips")
def _(t):
    return wl.scalar_totals(_trips(t), "total_amount", F.col("payment_method") == "Cash")


@query("w01_runs_last_day", f"SELECT count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'success') AS succeeded, max(records_failed) AS worst FROM runs WHERE started_at >= {AS_OF} - INTERVAL 24 HOUR", "runs")
def _(t):
    recent = t.runs.filter(F.col("started_at") >= x.back(t.as_of, "24 hours"))
    return recent.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("succeeded"),
                      F.max("records_failed").alias("worst"))


def _period(unit: str, col: str) -> str:
    return f"CAST(CAST(date_trunc('{unit}', {col}) AS DATE) AS VARCHAR)"


@query("w02_monthly_trend", f"SELECT {_period('month', 'created_at')} AS period, count(*) AS rows, {D('sum(order_total)')} AS amount FROM shop_orders GROUP BY 1", "shop_orders")
def _(t):
    return wl.trend(t.shop_orders, "created_at", "month", "order_total")


@query("w02_daily_trend", f"SELECT {_period('day', 'pickup_at')} AS period, count(*) AS rows, {D('sum(total_amount)')} AS amount FROM stg_trips GROUP BY 1", "stg_trips")
def _(t):
    return wl.trend(_trips(t), "pickup_at", "day", "total_amount")


@query("w03_top_routes", f"""SELECT pu_location_id, do_location_id, count(*) AS trips, {R(AVG('total_amount'), 2)} AS avg_fare FROM stg_trips GROUP BY 1, 2
    HAVING count(*) > 2 ORDER BY trips DESC, 1, 2 LIMIT 10""", "stg_trips")
def _(t):
    return wl.top_routes(_trips(t), 2)


@query("w03_popular_products", """SELECT product_id, count(DISTINCT customer_id) AS customers FROM shop_items i JOIN shop_orders o ON i.order_id = o.id GROUP BY 1
    HAVING count(DISTINCT customer_id) > 20""", "shop_items shop_orders")
def _(t):
    pairs = t.shop_items.select("product_id", "order_id").distinct().join(t.shop_orders, F.col("order_id") == F.col("id")) \
        .select("product_id", "customer_id").distinct()
    return pairs.groupBy("product_id").agg(F.count("*").alias("customers")).filter(F.col("customers") > 20)


@query("w03_new_customer_revenue", f"""WITH c AS (SELECT customer_id, min(created_at) AS f, sum(order_total) AS spend FROM shop_orders GROUP BY 1)
    SELECT count(*) AS new_customers, {D('coalesce(sum(spend), 0)')} AS revenue FROM c WHERE f >= {ORDERS_AS_OF} - INTERVAL 1500 DAY""", "shop_orders")
def _(t):
    return wl.new_customer_revenue(t.shop_orders, t.orders_as_of, 1500)


@query("w03_top_payment_method", f"""SELECT payment_method, {D('sum(fare_amount)')} AS fares FROM stg_trips WHERE pickup_at >= {AS_OF} - INTERVAL 30 DAY
    GROUP BY 1 ORDER BY sum(fare_amount) DESC, 1 LIMIT 1""", "stg_trips")
def _(t):
    recent = _trips(t).filter(F.col("pickup_at") >= x.back(t.as_of, "30 days"))
    return recent.groupBy("payment_method").agg(F.sum("fare_amount").alias("fares")).orderBy(F.desc("fares"), "payment_method").limit(1)


@query("w04_never_ordered", """SELECT c_custkey AS customer_id FROM customer WHERE c_custkey NOT IN
    (SELECT customer_id FROM shop_orders WHERE status = 'completed' AND region = '1-URGENT')""", "shop_orders")
def _(t):
    kept = t.shop_orders.filter((F.col("status") == "completed") & (F.col("region") == "1-URGENT"))
    return wl.without_orders(t.customer.select(F.col("c_custkey").alias("customer_id")), kept)


@query("w04_inactive", f"SELECT customer_id, max(created_at) AS last_order_at FROM shop_orders GROUP BY 1 HAVING max(created_at) < {ORDERS_AS_OF} - INTERVAL 90 DAY", "shop_orders")
def _(t):
    return wl.inactive(t.shop_orders, t.orders_as_of)


@query("w04_active_every_month", """SELECT customer_id, count(DISTINCT extract(month FROM created_at)) AS periods FROM shop_orders WHERE extract(year FROM created_at) = 1997
    GROUP BY 1 HAVING count(DISTINCT extract(month FROM created_at)) = 12""", "shop_orders")
def _(t):
    return wl.active_every(t.shop_orders, 1997)


@query("w04_active_every_quarter", """SELECT customer_id, count(DISTINCT extract(quarter FROM created_at)) AS periods FROM shop_orders WHERE extract(year FROM created_at) = 1997
    GROUP BY 1 HAVING count(DISTINCT extract(quarter FROM created_at)) = 4""", "shop_orders")
def _(t):
    return wl.active_every(t.shop_orders, 1997, "quarter")


@query("w05_above_average", f"SELECT trip_id, {D('fare_amount')} AS fare_amount FROM stg_trips WHERE fare_amount::DOUBLE > (SELECT avg(fare_amount::DOUBLE) FROM stg_trips)", "stg_trips")
def _(t):
    return wl.above_average(_trips(t).select("trip_id", "fare_amount"), "fare_amount")


@query("w05_above_category_average", f"""SELECT id, p.category, {D('cost')} AS cost FROM shop_products p JOIN (SELECT category, {AVG('cost')} AS m FROM shop_products GROUP BY 1) g
    ON p.category = g.category WHERE CAST(cost AS DOUBLE) > m""", "shop_products")
def _(t):
    return wl.above_group_average(t.shop_products, "category", "cost").select("id", "category", "cost")


@query("w05_distance_outliers", f"""SELECT trip_id, {D('trip_distance_miles')} AS trip_distance_miles FROM stg_trips
    WHERE trip_distance_miles::DOUBLE > (SELECT avg(trip_distance_miles::DOUBLE) + 1.5 * stddev_samp(trip_distance_miles::DOUBLE) FROM stg_trips)""", "stg_trips")
def _(t):
    return wl.outliers(_trips(t).select("trip_id", "trip_distance_miles"), "trip_distance_miles", 1.5)


@query("w06_orders_of_top_customers", f"""SELECT id, customer_id, {D('order_total')} AS order_total FROM shop_orders WHERE customer_id IN
    (SELECT customer_id FROM shop_orders GROUP BY 1 ORDER BY sum(order_total) DESC, 1 LIMIT 10)""", "shop_orders")
def _(t):
    return wl.orders_of_top_customers(t.shop_orders).select("id", "customer_id", "order_total")


@query("w07_tip_share", f"""SELECT payment_method, {PCT('tip_amount > 1', 2)} AS tipped_pct, {R('CAST(sum(tip_amount) AS DOUBLE) / CAST(sum(fare_amount) AS DOUBLE)', 4)} AS tip_to_fare
    FROM stg_trips GROUP BY 1""", "stg_trips")
def _(t):
    return wl.tip_share(_trips(t))


@query("w07_failure_rate_by_region", f"""WITH r AS (SELECT region, count(*) AS rows, {PCT("status = 'cancelled'", 2)} AS failure_pct FROM shop_orders GROUP BY 1)
    SELECT *, rank() OVER (ORDER BY failure_pct) AS rank FROM r""", "shop_orders")
def _(t):
    return wl.failure_rate_by(t.shop_orders, "region", F.col("status") == "cancelled")


@query("w08_product_ranks", f"""SELECT product_id, {D('revenue')} AS revenue, rank() OVER (ORDER BY revenue DESC) AS rank FROM
    (SELECT product_id, CAST(sum(quantity * unit_price) AS DECIMAL(20,2)) AS revenue FROM shop_items GROUP BY 1)""", "shop_items")
def _(t):
    return wl.product_ranks(t.shop_items)


_DAILY = "d AS (SELECT CAST(pickup_at AS DATE) AS period, count(*) AS rows, sum(total_amount) AS amount FROM stg_trips GROUP BY 1)"
_MONTHLY = "m AS (SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, count(*) AS rows, sum(order_total) AS amount FROM shop_orders GROUP BY 1)"


def _daily(t):
    return wl.trend(_trips(t), "pickup_at", "day", "total_amount")


def _monthly(t):
    return wl.trend(t.shop_orders, "created_at", "month", "order_total")


@query("w08_running_total", f"WITH {_DAILY} SELECT CAST(period AS VARCHAR) AS period, {D('amount')} AS amount, {D('sum(amount) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING)')} AS total FROM d", "stg_trips")
def _(t):
    return sr.running_total(_daily(t), [], "period", "amount", "total").select("period", "amount", "total")


@query("w08_month_over_month", f"""WITH {_MONTHLY}, l AS (SELECT *, lag(amount, 1, 0) OVER (ORDER BY period) AS previous FROM m)
    SELECT CAST(period AS VARCHAR) AS period, {D('amount')} AS amount, {D('previous')} AS previous,
    {R('100.0 * (CAST(amount - previous AS DOUBLE) / nullif(CAST(previous AS DOUBLE), 0))', 2)} AS growth_pct FROM l""", "shop_orders")
def _(t):
    return sr.with_change(_monthly(t), [], "period", "amount").select("period", "amount", "previous", "growth_pct")


@query("w08_rolling_average", f"""WITH {_DAILY} SELECT CAST(period AS VARCHAR) AS period, rows,
    {R('CAST(sum(rows) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(rows) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 2)} AS rolling_avg FROM d""", "stg_trips")
def _(t):
    return sr.moving_average(_daily(t), [], "period", "rows", "rolling_avg").select("period", "rows", "rolling_avg")


@query("w08_declining_products", """WITH m AS (SELECT product_id, CAST(date_trunc('month', created_at) AS DATE) AS period, count(DISTINCT order_id) AS orders
        FROM shop_items i JOIN shop_orders o ON i.order_id = o.id GROUP BY 1, 2),
    l AS (SELECT *, lag(orders) OVER (PARTITION BY product_id ORDER BY period) AS previous FROM m)
    SELECT product_id, CAST(period AS VARCHAR) AS period, orders, previous FROM l WHERE orders < previous""", "shop_items shop_orders")
def _(t):
    monthly = t.shop_items.select("product_id", "order_id").distinct().join(t.shop_orders, F.col("order_id") == F.col("id")).groupBy(
        "product_id", x.month_start(F.col("created_at")).alias("period")).agg(F.count("*").alias("orders"))
    return sr.declining(monthly, ["product_id"], "period", "orders")


@query("w09_busiest_hour", "SELECT pickup_hour AS period, count(*) AS rows FROM stg_trips GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "stg_trips")
def _(t):
    return wl.busiest(_trips(t), F.col("pickup_hour"))


@query("w09_busiest_day", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS period, count(*) AS rows FROM shop_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "shop_orders")
def _(t):
    return wl.busiest(t.shop_orders, F.to_date("created_at"))


@query("w09_worst_weekday", "SELECT CAST(extract(dow FROM started_at) AS INTEGER) AS period, count(*) AS rows FROM runs WHERE status = 'failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "runs")
def _(t):
    return wl.busiest(t.runs.filter(F.col("status") == "failed"), x.dow(F.col("started_at")))


@query("w10_success_rates", f"""WITH r AS (SELECT pipeline_name, count(*) AS runs, {PCT("status = 'success'", 2)} AS success_pct, {PCT("status = 'failed'", 2)} AS failure_pct,
    CAST(sum(records_loaded) AS BIGINT) AS records_loaded FROM fleet GROUP BY 1) SELECT *, rank() OVER (ORDER BY failure_pct DESC) AS failure_rank FROM r""", "fleet")
def _(t):
    return wl.success_rates(t.fleet)


@query("w10_failure_streaks", """WITH s AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY pipeline_name ORDER BY started_at, run_no ROWS UNBOUNDED PRECEDING) AS g FROM fleet)
    SELECT pipeline_name, min(started_at) AS streak_start, max(started_at) AS streak_end, count(*) AS length FROM s WHERE status = 'failed' GROUP BY pipeline_name, g HAVING count(*) > 2""", "fleet")
def _(t):
    return wl.long_failure_streaks(t.fleet, 2)


_CUT = "TIMESTAMP '2024-01-16'"


def _sides(name: str, cond: str) -> str:
    return f"""{R(f"100.0::DOUBLE * (count(*) FILTER (WHERE {cond} AND status = 'failed') / nullif(CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE), 0))", 2)} AS failure_pct_{name},
        {R(f"CAST(sum(duration_seconds) FILTER (WHERE {cond}) AS DOUBLE) / nullif(count(*) FILTER (WHERE {cond}), 0)", 2)} AS avg_duration_{name}"""


@query("w10_drift_by_source", """SELECT source_type, count(*) AS drift_runs FROM runs WHERE status = 'failed' AND (error_message LIKE 'schema evolution%' OR error_message LIKE 'schema mismatch%'
    OR error_message LIKE 'catalog error%') GROUP BY 1""", "runs")
def _(t):
    return wl.schema_errors_by_source(t.runs)


@query("w11_before_after", f"SELECT pipeline_name, {_sides('before', f'started_at < {_CUT}')}, {_sides('after', f'started_at >= {_CUT}')} FROM fleet GROUP BY 1", "fleet")
def _(t):
    return wl.before_after(t.fleet, F.lit("2024-01-16").cast("timestamp_ntz"))


@query("w12_followed_by", """WITH n AS (SELECT *, lead(anomaly_type) OVER w AS nt, lead(detection_at) OVER w AS next_at FROM incidents WINDOW w AS (PARTITION BY pipeline_name ORDER BY detection_at, incident_id))
    SELECT pipeline_name, incident_id, detection_at, next_at FROM n WHERE anomaly_type = 'ROW_COUNT_DROP' AND nt = 'NULL_SPIKE'""", "incidents")
def _(t):
    return wl.followed_by(t.incidents, "ROW_COUNT_DROP", "NULL_SPIKE")


@query("w12_consecutive_days", """WITH d AS (SELECT DISTINCT pipeline_name, anomaly_type, CAST(detection_at AS DATE) AS day FROM incidents),
    g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY pipeline_name, anomaly_type ORDER BY day) AS INTEGER) AS island FROM d)
    SELECT pipeline_name, anomaly_type, CAST(min(day) AS VARCHAR) AS first_day, count(*) AS days FROM g GROUP BY pipeline_name, anomaly_type, island HAVING count(*) > 3""", "incidents")
def _(t):
    return wl.consecutive_days(t.incidents, ["pipeline_name", "anomaly_type"])


@query("w13_slower_than_last_week", f"""WITH w AS (SELECT pipeline_name,
        CAST(sum(duration_seconds) FILTER (WHERE started_at >= {AS_OF} - INTERVAL 7 DAY) AS DOUBLE) / nullif(count(*) FILTER (WHERE started_at >= {AS_OF} - INTERVAL 7 DAY), 0) AS t,
        CAST(sum(duration_seconds) FILTER (WHERE started_at < {AS_OF} - INTERVAL 7 DAY) AS DOUBLE) / nullif(count(*) FILTER (WHERE started_at < {AS_OF} - INTERVAL 7 DAY), 0) AS l
        FROM fleet WHERE started_at >= {AS_OF} - INTERVAL 14 DAY GROUP BY 1)
    SELECT pipeline_name, {R('t', 2)} AS this_week, {R('l', 2)} AS last_week FROM w WHERE t > l * 1.5""", "fleet")
def _(t):
    return wl.slower_than_last_week(t.fleet, t.as_of)


@query("w14_failure_correlation", f"""WITH f AS (SELECT pipeline_name, CAST(started_at AS DATE) AS day, sum(records_failed) AS f FROM runs GROUP BY 1, 2),
    i AS (SELECT pipeline_name, CAST(detection_at AS DATE) AS day, count(*) AS n FROM incidents GROUP BY 1, 2)
    SELECT f.pipeline_name, {R('corr(CAST(f AS DOUBLE), CAST(coalesce(n, 0) AS DOUBLE))', 4)} AS correlation, count(*) AS days
    FROM f LEFT JOIN i ON f.pipeline_name = i.pipeline_name AND f.day = i.day GROUP BY 1""", "runs incidents")
def _(t):
    return wl.failure_correlation(t.runs, t.incidents)


@query("w15_cumulative_loaded", """SELECT pipeline_name, run_no, started_at, CAST(sum(records_loaded) OVER (PARTITION BY pipeline_name ORDER BY started_at, run_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM runs""", "runs")
def _(t):
    slim = t.runs.select("pipeline_name", "run_no", "started_at", "records_loaded")
    return with_running_sum(slim, ["pipeline_name"], "started_at", "run_no", "records_loaded", "cumulative").drop("records_loaded")


@query("w15_heal_rank", f"""WITH r AS (SELECT pipeline_name, {PCT("outcome IN ('approved', 'auto_healed')", 2)} AS heal_pct, count(*) AS incidents FROM incidents
    WHERE detection_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1) SELECT *, rank() OVER (ORDER BY heal_pct DESC) AS heal_rank FROM r""", "incidents")
def _(t):
    return wl.heal_rank(t.incidents, t.as_of)


# ---- aggregation, window, sort and set capabilities ------------------------------------------

@query("n03_mode", """SELECT * EXCLUDE rn FROM (SELECT o_custkey, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
    FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def _(t):
    from tidemill.plans.marts import most_frequent
    return most_frequent(t.orders, "o_custkey", "o_orderpriority", "p").withColumnRenamed("p", "priority")


@query("n04_percentiles", f"""SELECT l_returnflag, count(*) AS n, {', '.join(R(f'quantile_cont(l_extendedprice, {p})', 4) + f' AS p{int(p * 100)}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))}
    FROM lineitem GROUP BY 1""")
def _(t):
    probs = {f"p{int(p * 100)}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    # A small accuracy makes even test-sized groups take the bracketed path.
    out = exact_percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", probs, accuracy=1000)
    return out.select("l_returnflag", "n", *[x.rnd(F.col(c), 4).alias(c) for c in probs])


@query("n05_median_deviation", f"SELECT o_orderpriority, {R('median(o_totalprice)', 4)} AS median, {R('stddev_samp(o_totalprice)', 4)} AS deviation FROM orders GROUP BY 1")
def _(t):
    median = exact_percentiles(t.orders, ["o_orderpriority"], "o_totalprice", {"median": 0.5})
    return t.orders.groupBy("o_orderpriority").agg(x.rnd(F.stddev_samp("o_totalprice"), 4).alias("deviation")).join(
        median.select("o_orderpriority", x.rnd(F.col("median"), 4).alias("median")), "o_orderpriority")


@query("n07_approx_distinct")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("n07_approx_distinct_error", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS within_bound FROM lineitem GROUP BY 1")
def _(t):
    # Three times the relative deviation that the sketch is asked for.
    exact, sketch = F.count_distinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    return t.lineitem.groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(sketch / exact - 1) <= 0.06).alias("within_bound"))


@query("n08_share_of_total", f"""SELECT o_orderstatus, o_orderpriority, n, {R('100.0 * (CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS DOUBLE))', 2)} AS share_pct
    FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)""")
def _(t):
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return sr.share_of_total(counts, ["o_orderstatus"], "n", "share_pct")


@query("n10_moving_average", f"""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2)
    SELECT event_type, CAST(day AS VARCHAR) AS day, {R('CAST(sum(v) OVER w AS DOUBLE) / count(v) OVER w', 2)} AS avg7 FROM d
    WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum(x.money(F.col("value"))).alias("v"))
    return sr.moving_average(daily, ["event_type"], "day", "v", "avg7").drop("v")


@query("n11_top_per_group", """SELECT o_custkey, o_orderkey, o_totalprice, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 3""")
def _(t):
    return sr.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("n12_lag_default", """SELECT event_type, CAST(day AS VARCHAR) AS day, n, lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY day) AS previous
    FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)""")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return sr.with_change(daily, ["event_type"], "day", "n").drop("growth_pct")


@query("n13_gap_filling", """WITH s AS (SELECT CAST(range AS DATE) AS day FROM range((SELECT date_trunc('day', min(created_at)) FROM shop_orders), (SELECT date_trunc('day', max(created_at)) FROM shop_orders) + INTERVAL 1 DAY, INTERVAL 1 DAY)),
    n AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS orders FROM shop_orders WHERE status = 'completed' AND region = '1-URGENT' GROUP BY 1)
    SELECT CAST(s.day AS VARCHAR) AS day, coalesce(orders, 0) AS orders FROM s LEFT JOIN n ON s.day = n.day""", "shop_orders")
def _(t):
    bounds = t.shop_orders.agg(F.to_date(F.min("created_at")).alias("lo"), F.to_date(F.max("created_at")).alias("hi"))
    spine = x.date_spine(t.spark, bounds.select("lo").scalar(), bounds.select("hi").scalar(), "day")
    kept = t.shop_orders.filter((F.col("status") == "completed") & (F.col("region") == "1-URGENT"))
    return sr.fill_gaps(spine, kept.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("orders")), "day", "orders")


@query("n14_page_nulls_last", "SELECT order_id, amount FROM damaged ORDER BY amount DESC NULLS LAST, order_id LIMIT 50 OFFSET 25", "damaged")
def _(t):
    return t.damaged.select("order_id", "amount").orderBy(F.desc_nulls_last("amount"), "order_id").offset(25).limit(50)


@query("n18_window_filter", """SELECT pipeline_name, run_no, duration_seconds FROM (SELECT pipeline_name, run_no, CAST(duration_seconds AS DOUBLE) AS duration_seconds,
    rank() OVER (PARTITION BY pipeline_name ORDER BY duration_seconds DESC) AS r FROM fleet) WHERE r = 1""", "fleet")
def _(t):
    r = F.rank().over(W.partitionBy("pipeline_name").orderBy(F.desc("duration_seconds")))
    return t.fleet.select("pipeline_name", "run_no", "duration_seconds").withColumn("r", r).filter("r = 1").drop("r")


# ---- join shapes -----------------------------------------------------------------------------

@query("j01_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    return t.customer.join(t.orders.filter(F.col("o_totalprice") > 400000), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j02_join_one_row_aggregate", f"SELECT o_orderkey, {R('o_totalprice / (SELECT max(o_totalprice) FROM orders)', 4)} AS of_max FROM orders")
def _(t):
    top = t.orders.agg(F.max("o_totalprice")).scalar()
    return t.orders.select("o_orderkey", x.rnd(F.col("o_totalprice") / top, 4).alias("of_max"))


@query("j03_full_outer", """SELECT coalesce(a.d, b.d) AS day, coalesce(o, 0) AS orders, coalesce(s, 0) AS shipped FROM
    (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, count(*) AS o FROM orders GROUP BY 1) a FULL OUTER JOIN
    (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, count(*) AS s FROM lineitem GROUP BY 1) b ON a.d = b.d""")
def _(t):
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("o"))
    b = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("s"))
    return a.join(b, "day", "full_outer").select("day", F.coalesce("o", F.lit(0)).alias("orders"), F.coalesce("s", F.lit(0)).alias("shipped"))


@query("j04_bucketed_join", f"""SELECT o_orderkey, count(*) AS lines, {D('sum(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS amount
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), x.money(F.col("l_extendedprice")).alias("price"))
    buckets = bucket_count(t.orders, t.lineitem)
    left, right = (
        write_bucketed(df, f"{label}_{uuid.uuid4().hex}", scratch_path(t.spark, label), ["o_orderkey"], buckets)
        for df, label in ((t.orders.select("o_orderkey"), "orders"), (lines, "lines"))
    )
    return left.join(right, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.sum("price").alias("amount"))
