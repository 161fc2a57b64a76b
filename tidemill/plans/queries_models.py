"""Queries: staging and mart models, model tests, macros."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import exprs as x
from tidemill.plans import build, marts, model_tests, staging
from tidemill.plans.oracle import AVG, D, R, lit
from tidemill.plans.registry import query
from tidemill.session import scratch_path


def _trips(t):
    return staging.stg_trips(t.taxi)


def _orders(t):
    return staging.stg_orders(t.shop)


_TRIP_NUM = "trip_duration_min trip_distance_miles fare_amount tip_amount total_amount".split()


@query("m01_stg_trips", f"SELECT * REPLACE ({', '.join(f'{D(c)} AS {c}' for c in _TRIP_NUM)}) FROM stg_trips", "stg_trips")
def _(t):
    return _trips(t)


@query("m02_stg_orders", f"SELECT * REPLACE ({D('unit_price')} AS unit_price, {D('total_amount')} AS total_amount) FROM stg_orders", "stg_orders")
def _(t):
    return _orders(t)


@query("m03_fct_trips",
       f"SELECT * REPLACE (CAST(pickup_date AS VARCHAR) AS pickup_date, {', '.join(f'{D(c)} AS {c}' for c in _TRIP_NUM)}) FROM fct_trips",
       "fct_trips")
def _(t):
    return marts.fct_trips(_trips(t))


@query("m04_fct_orders", f"""SELECT order_key, order_id, customer_id, product_name, category, {D('unit_price')} AS unit_price, quantity,
    {D('total_amount')} AS total_amount, status, is_completed, city, ordered_at, order_month_key FROM stg_orders""", "stg_orders")
def _(t):
    return marts.fct_orders(_orders(t))


@query("m05_ecommerce_summary", "SELECT * REPLACE (CAST(order_date AS VARCHAR) AS order_date) FROM fct_summary", "fct_summary")
def _(t):
    return marts.fct_ecommerce_summary(_orders(t))


@query("m06_revenue_by_category", f"""
    WITH e AS (SELECT i.order_id, i.quantity, CAST(i.quantity * i.unit_price AS DECIMAL(18,2)) AS line_revenue, p.category,
                      CAST(date_trunc('month', o.created_at) AS DATE) AS revenue_month
               FROM shop_items i JOIN shop_products p ON i.product_id = p.id JOIN shop_orders o ON i.order_id = o.id
               WHERE o.status IN ('completed', 'shipped')),
         m AS (SELECT revenue_month, category, count(DISTINCT order_id) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold,
                      sum(line_revenue) AS revenue, {R(AVG('line_revenue'), 2)} AS avg_line_revenue,
                      {R('CAST(sum(line_revenue) AS DOUBLE) / count(DISTINCT order_id)', 2)} AS avg_order_value
               FROM e GROUP BY 1, 2)
    SELECT CAST(revenue_month AS VARCHAR) AS revenue_month, category, order_count, units_sold, {D('revenue')} AS total_revenue,
           avg_line_revenue, avg_order_value,
           {R('100.0::DOUBLE * (CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER (PARTITION BY revenue_month) AS DOUBLE))', 2)} AS revenue_share_pct
    FROM m""", "shop_items shop_products shop_orders")
def _(t):
    return marts.fct_revenue_by_category(t.shop_items, t.shop_products, t.shop_orders)


# Months are numbered from year 0, so that differences are plain; a customer's cohort is its own earliest month.
@query("m07_customer_cohort", f"""
    WITH spend AS (SELECT customer_id AS who, 12 * year(created_at) + month(created_at) - 1 AS m, sum(order_total) AS paid
                   FROM shop_orders WHERE status = ANY(['shipped', 'completed']) GROUP BY ALL),
         grid AS (SELECT born, m, count(*) AS n, sum(paid) AS paid
                  FROM (SELECT m, paid, min(m) OVER (PARTITION BY who) AS born FROM spend) GROUP BY ALL)
    SELECT strftime(make_date(born // 12, born % 12 + 1, 1), '%Y-%m-%d') AS cohort_month,
           strftime(make_date(m // 12, m % 12 + 1, 1), '%Y-%m-%d') AS activity_month,
           CAST((m - born) % 12 AS INTEGER) AS months_since_acquisition, CAST(m - born AS INTEGER) AS months_total,
           first_value(n) OVER cohort AS cohort_size, n AS active_customers,
           {R('100.0::DOUBLE * n / first_value(n) OVER cohort', 1)} AS retention_pct,
           {D('paid')} AS cohort_revenue, {R('CAST(paid AS DOUBLE) / n', 2)} AS revenue_per_active_customer
    FROM grid WINDOW cohort AS (PARTITION BY born ORDER BY m)""", "shop_orders")
def _(t):
    return marts.fct_customer_cohort(t.shop_orders)


@query("m08_dim_customers", "SELECT * FROM dim_customers", "dim_customers")
def _(t):
    return marts.dim_customers(_orders(t))


@query("m09_dim_taxi_zones", "SELECT * FROM dim_zones", "dim_zones")
def _(t):
    return marts.dim_taxi_zones(_trips(t))


@query("m10_dim_locations", f"""
    SELECT place AS location_id, count(DISTINCT trip_id) AS num_trips, count(*) FILTER (WHERE is_airport_trip) AS num_airport_trips,
           {', '.join(f"{D(f'sum({c})')} AS total_{c.removeprefix('trip_')}" for c in (
               'trip_distance_miles', 'fare_amount', 'tip_amount', 'total_amount'))}
    FROM (SELECT *, unnest([pu_location_id, do_location_id]) AS place FROM stg_trips) GROUP BY place""", "stg_trips")
def _(t):
    return marts.dim_locations(_trips(t))


# Each source is grouped by itself; only rows without a place on either side fall together.
_PLACES = {"location_id": ("pu_location_id", "stg_trips", "trip_id", "fare_amount"), "city": ("city", "stg_orders", "order_id", "total_amount")}


@query("m11_dim_geography", f"""
    SELECT any_value(location_id) AS location_id, any_value(city) AS city,
           coalesce(sum(n) FILTER (WHERE kind = 'city'), 0)::BIGINT AS num_orders,
           coalesce(sum(n) FILTER (WHERE kind = 'location_id'), 0)::BIGINT AS num_trips,
           {D("sum(paid) FILTER (WHERE kind = 'city')")} AS total_order_amount, {D("sum(paid) FILTER (WHERE kind = 'location_id')")} AS total_trip_amount
    FROM ({' UNION ALL BY NAME '.join(f"SELECT '{kind}' AS kind, {column} AS {kind}, count(DISTINCT {i}) AS n, sum({x}) AS paid FROM {table} GROUP BY {column}"
                                      for kind, (column, table, i, x) in _PLACES.items())})
    GROUP BY coalesce(CAST(location_id AS VARCHAR), ''), coalesce(city, '')""", "stg_trips stg_orders")
def _(t):
    return marts.dim_geography(_trips(t), _orders(t))


@query("m12_dim_payment_types", """SELECT DISTINCT payment_type, CASE payment_type WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Cash'
    WHEN 3 THEN 'No Charge' WHEN 4 THEN 'Dispute' WHEN 5 THEN 'Unknown' ELSE 'Other' END AS payment_type_description FROM taxi""", "taxi")
def _(t):
    return marts.dim_payment_types(t.taxi)


@query("m13_dim_payments", """SELECT payment_type, payment_type AS payment_type_description FROM (
    SELECT * FROM (SELECT DISTINCT payment_method AS payment_type FROM stg_trips WHERE payment_method IS NOT NULL)
    UNION ALL SELECT * FROM (SELECT DISTINCT 'Credit Card' AS payment_type FROM stg_orders WHERE order_id IS NOT NULL))""", "stg_trips stg_orders")
def _(t):
    return marts.dim_payments(_trips(t), _orders(t))


@query("m14_dim_products", "SELECT DISTINCT product_name AS product_id, product_name, category AS product_category FROM stg_orders", "stg_orders")
def _(t):
    return marts.dim_products(_orders(t))


@query("m15_dim_vendors", "SELECT DISTINCT vendor_name AS vendor_id, vendor_name FROM stg_trips", "stg_trips")
def _(t):
    return marts.dim_vendors(_trips(t))


@query("m15_dim_ratecodes", "SELECT DISTINCT vendor_id AS rate_code FROM taxi", "taxi")
def _(t):
    return marts.dim_ratecodes(t.taxi)


_PARTS = "year month day hour minute quarter week dow".split()


@query("m16_dim_time", f"""SELECT {', '.join(f"CAST(extract({p} FROM seen) AS INTEGER) AS {'day_of_week' if p == 'dow' else p}" for p in _PARTS)}
    FROM (SELECT pickup_at AS seen FROM stg_trips UNION ALL SELECT ordered_at FROM stg_orders)""", "stg_trips stg_orders")
def _(t):
    return marts.dim_time(_trips(t), _orders(t))


def _closed_lines(t):
    """Lines of closed orders with day and region, revenue and profit."""
    return (
        t.shop_items.alias("i")
        .join(t.shop_orders.filter(F.col("status") != "cancelled").alias("o"), F.col("i.order_id") == F.col("o.id"))
        .join(t.shop_products.alias("p"), F.col("i.product_id") == F.col("p.id"))
        .select(
            x.day(F.col("o.created_at")).alias("day"), F.col("o.region"), F.col("o.id").alias("order_id"), F.col("o.customer_id"),
            x.money(F.col("i.quantity") * F.col("i.unit_price")).alias("revenue"),
            x.money(F.col("i.quantity") * (F.col("i.unit_price") - F.col("p.cost"))).alias("profit"),
        )
    )


@query("m17_daily_metrics", f"""
    SELECT CAST(CAST(o.created_at AS DATE) AS VARCHAR) AS day, o.region, count(DISTINCT o.id) AS total_orders,
           {D('sum(CAST(i.quantity * i.unit_price AS DECIMAL(18,2)))')} AS total_revenue,
           {D('sum(CAST(i.quantity * (i.unit_price - p.cost) AS DECIMAL(18,2)))')} AS total_profit,
           count(DISTINCT o.customer_id) AS customers,
           {R('CAST(sum(CAST(i.quantity * i.unit_price AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT o.id)', 2)} AS avg_order_value
    FROM shop_items i JOIN shop_orders o ON i.order_id = o.id JOIN shop_products p ON i.product_id = p.id
    WHERE o.status <> 'cancelled' GROUP BY 1, 2""", "shop_items shop_orders shop_products")
def _(t):
    return marts.daily_metrics(_closed_lines(t))


def _people(t):
    return t.customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )


@query("m18_customer_ltv", f"""
    SELECT c_custkey AS customer_id, c_name || ' ' || c_mktsegment AS full_name, count(o.id) AS total_orders,
           {D('coalesce(sum(o.order_total), 0)')} AS lifetime_value, max(o.created_at) AS last_order_at
    FROM customer LEFT JOIN shop_orders o ON o.customer_id = c_custkey GROUP BY 1, 2""", "shop_orders")
def _(t):
    return marts.customer_ltv(_people(t), t.shop_orders)


@query("m19_fact_orders", f"""
    SELECT o.id AS order_id, c_custkey AS customer_id, c_mktsegment AS segment, p.category, i.quantity,
           CAST(extract(year FROM o.created_at) AS INTEGER) AS order_year, CAST(extract(month FROM o.created_at) AS INTEGER) AS order_month,
           CAST(extract(quarter FROM o.created_at) AS INTEGER) AS order_quarter, {D('i.quantity * i.unit_price')} AS line_total,
           {D('i.quantity * i.unit_price - p.cost * i.quantity')} AS gross_profit
    FROM shop_items i JOIN shop_orders o ON i.order_id = o.id JOIN shop_products p ON i.product_id = p.id
    JOIN customer ON o.customer_id = c_custkey""", "shop_items shop_orders shop_products")
def _(t):
    return marts.fact_orders(t.shop_items, t.shop_orders, _people(t), t.shop_products)


@query("m20_warehouse_trips", """SELECT 'trip_' || id AS trip_id, pickup_datetime, dropoff_datetime,
    CAST(passenger_count AS INTEGER) AS passenger_count, CAST(trip_distance AS FLOAT) AS trip_distance,
    CAST(fare_amount AS FLOAT) AS fare_amount, CAST(tip_amount AS FLOAT) AS tip_amount, CAST(total_amount AS FLOAT) AS total_amount,
    CASE payment_type WHEN 1 THEN 'credit_card' WHEN 2 THEN 'cash' WHEN 3 THEN 'no_charge' WHEN 4 THEN 'dispute' ELSE 'unknown' END AS payment_type
    FROM taxi""", "taxi")
def _(t):
    return staging.warehouse_trips(t.taxi)


@query("m21_cents_to_dollars", f"""SELECT c_mktsegment AS segment, {R('CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE', 2)} AS balance
    FROM customer GROUP BY 1""")
def _(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        x.rnd(x.cents_to_dollars(F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint"))), 2).alias("balance")
    )


@query("m22_safe_divide", f"SELECT query_id, {R('optimized_cost / nullif(original_cost, 0)', 4)} AS cost_ratio FROM query_log", "query_log")
def _(t):
    return t.query_log.select(
        "query_id", x.rnd(x.safe_divide(F.col("optimized_cost"), F.col("original_cost")), 4).alias("cost_ratio")
    )


@query("m23_date_spine", """
    WITH d AS (SELECT CAST(range AS DATE) AS date_day FROM range((SELECT date_trunc('day', min(o_orderdate)) FROM orders),
                  (SELECT date_trunc('day', max(o_orderdate)) FROM orders) + INTERVAL 1 DAY, INTERVAL 1 DAY)),
         n AS (SELECT CAST(o_orderdate AS DATE) AS date_day, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(d.date_day AS VARCHAR) AS date_day, coalesce(n, 0) AS orders FROM d LEFT JOIN n ON d.date_day = n.date_day""")
def _(t):
    bounds = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    spine = x.date_spine(t.spark, bounds.select("lo").scalar(), bounds.select("hi").scalar())
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("date_day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(daily, "date_day", "left").select("date_day", F.coalesce("n", F.lit(0)).alias("orders"))


@query("m24_not_empty_string", "SELECT count(*) FILTER (WHERE category IS NOT NULL AND trim(category) <> '') AS filled, count(*) AS total FROM damaged", "damaged")
def _(t):
    return t.damaged.agg(
        F.count_if(x.not_empty_string(F.col("category"))).alias("filled"), F.count(F.lit(1)).alias("total")
    )


def _suite_sql(tables: dict) -> str:
    rows = []
    for model, table in tables.items():
        for test in model_tests.SUITES[model]:
            c = test.column
            if test.kind == "unique":
                n = f"(SELECT count(*) FROM (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"
            elif test.kind == "not_null":
                n = f"(SELECT count(*) FROM {table} WHERE {c} IS NULL)"
            else:
                n = f"(SELECT count(*) FROM {table} WHERE {c} NOT IN ({', '.join(lit(v) for v in test.values)}))"
            rows.append(f"SELECT {lit(model)} AS model, {lit(c)} AS \"column\", {lit(test.kind)} AS test, {n} AS failures")
    body = " UNION ALL ".join(rows)
    return f"SELECT *, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({body})"


_BUILT = {"raw_trips": "taxi", "raw_orders": "shop", "stg_trips": "stg_trips", "stg_orders": "stg_orders", "fct_trips": "fct_trips",
          "dim_customers": "dim_customers", "fct_ecommerce_summary": "fct_summary", "dim_taxi_zones": "dim_zones"}


@query("t01_not_null_unique_accepted_trips", _suite_sql({"stg_trips": "stg_trips"}), "stg_trips")
def _(t):
    return model_tests.run_tests("stg_trips", _trips(t), model_tests.SUITES["stg_trips"])


@query("t02_not_null_unique_accepted_orders", _suite_sql({"stg_orders": "stg_orders"}), "stg_orders")
def _(t):
    return model_tests.run_tests("stg_orders", _orders(t), model_tests.SUITES["stg_orders"])


@query("t04_build_and_test_models", _suite_sql(_BUILT), " ".join(_BUILT.values()))
def _(t):
    return build.build_models(_sources(t), scratch_path(t.spark, "marts"))


def _sources(t):
    return {"raw_trips": t.taxi, "raw_orders": t.shop, "shop_items": t.shop_items, "shop_products": t.shop_products,
            "shop_orders": t.shop_orders}


@query("t03_source_suites", _suite_sql({"raw_trips": "taxi", "raw_orders": "shop"}), "taxi shop")
def _(t):
    known = _sources(t)
    trips, orders = (model_tests.run_tests(n, known[n], model_tests.SUITES[n]) for n in ("raw_trips", "raw_orders"))
    return trips.unionByName(orders)


@query("t04_suite_totals", f"""SELECT count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed,
    count(*) AS total FROM ({_suite_sql({'stg_orders': 'stg_orders'})})""", "stg_orders")
def _(t):
    return model_tests.totals(model_tests.run_tests("stg_orders", _orders(t), model_tests.SUITES["stg_orders"]))
