"""Mart models over the staging models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.constants import AIRPORT_ZONES
from tidemill.functions.exprs import dbl, dow, money, month_start, ratio_sum, rnd, safe_divide, share_pct
from tidemill.plans.staging import PAYMENTS


def fct_trips(trips: DataFrame) -> DataFrame:
    minutes, fare = F.col("trip_duration_min"), F.col("fare_amount")
    return trips.select(
        "trip_id",
        F.to_date("pickup_at").alias("pickup_date"),
        "pickup_hour", "pickup_day_of_week", "vendor_name", "pu_location_id", "do_location_id",
        "passenger_count", "trip_distance_miles", "trip_duration_min",
        F.when(minutes > 0, rnd(dbl(F.col("trip_distance_miles")) / (dbl(minutes) / 60.0), 2)).alias("avg_speed_mph"),
        "fare_amount", "tip_amount",
        F.when(fare > 0, rnd(dbl(F.col("tip_amount")) / dbl(fare) * 100, 1)).otherwise(0.0).alias("tip_pct"),
        "total_amount", "payment_method", "is_airport_trip",
    )


def fct_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_key", "order_id", "customer_id", "product_name", "category", "unit_price", "quantity",
        "total_amount", "status", "is_completed", "city", "ordered_at", "order_month_key",
    )


def fct_ecommerce_summary(orders: DataFrame) -> DataFrame:
    """Revenue, volume and completion per day, category and city."""
    # Lines hardly collapse before the first shuffle, so a task that counts them holds them all: the rebalance limits its share.
    lines = orders.select(F.to_date("ordered_at").alias("order_date"), "category", "city", "order_id", "customer_id", "quantity",
                          "total_amount", "is_completed", "status").hint("rebalance")
    # One row per order and customer first: the two distinct counts then expand those rows, not the lines.
    per_order = lines.groupBy("order_date", "category", "city", "order_id", "customer_id").agg(
        F.sum("quantity").alias("units"), F.sum("total_amount").alias("revenue"), F.count("total_amount").alias("amounts"),
        F.count(F.lit(1)).alias("lines"), F.count_if("is_completed").alias("completed"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
    )
    by_cell = per_order.groupBy("order_date", "category", "city").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum("units").alias("total_units_sold"),
        dbl(F.sum("revenue")).alias("total_revenue"),
        rnd(safe_divide(F.sum("revenue"), F.sum("amounts")), 2).alias("avg_order_value"),
        F.sum("completed").alias("completed_orders"),
        F.sum("cancelled").alias("cancelled_orders"),
        rnd(100.0 * safe_divide(F.sum("completed"), F.sum("lines")), 1).alias("completion_rate_pct"),
    )
    # The month follows from the day, so it need not travel through the shuffle as a key.
    return by_cell.withColumn("order_month_key", F.date_format("order_date", "yyyy-MM"))


def fct_revenue_by_category(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Monthly revenue per category with its share of the month."""
    month = month_start(F.col("o.created_at")).alias("revenue_month")
    kept = orders.filter(F.col("status").isin("completed", "shipped")).select("id", "created_at")
    lines = (
        items.alias("i")
        .join(products.select("id", "category").alias("p"), F.col("i.product_id") == F.col("p.id"))
        .join(kept.alias("o"), F.col("i.order_id") == F.col("o.id"))
        .select("i.order_id", "i.quantity", "p.category", month,
                money(F.col("i.quantity") * F.col("i.unit_price")).alias("line_revenue"))
    )
    # One row per order first, so that no (month, category) group carries raw lines into the distinct count.
    per_order = lines.groupBy("revenue_month", "category", "order_id").agg(
        F.sum("quantity").alias("units"), F.sum("line_revenue").alias("revenue"), F.count(F.lit(1)).alias("lines")
    )
    monthly = per_order.groupBy("revenue_month", "category").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("units").alias("units_sold"),
        F.sum("revenue").alias("revenue"),
        F.sum("lines").alias("lines"),
    )
    of_month = F.sum("revenue").over(W.partitionBy("revenue_month"))
    return monthly.select(
        "revenue_month", "category", "order_count", "units_sold",
        dbl(F.col("revenue")).alias("total_revenue"),
        rnd(safe_divide(F.col("revenue"), F.col("lines")), 2).alias("avg_line_revenue"),
        rnd(safe_divide(F.col("revenue"), F.col("order_count")), 2).alias("avg_order_value"),
        rnd(100.0 * safe_divide(F.col("revenue"), of_month), 2).alias("revenue_share_pct"),
    )


def months_between_starts(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def fct_customer_cohort(orders: DataFrame) -> DataFrame:
    """Retention and revenue per first-purchase month and activity month.

    ``months_since_acquisition`` is the month component only (0-11); ``months_total`` does not wrap.
    """
    monthly = (
        orders.filter(F.col("status").isin("completed", "shipped"))
        .groupBy("customer_id", month_start(F.col("created_at")).alias("activity_month"))
        .agg(F.sum("order_total").alias("monthly_revenue"))
    )
    # At most one row per customer and month, so the per-customer window is bounded by the calendar.
    activity = monthly.withColumn("cohort_month", F.min("activity_month").over(W.partitionBy("customer_id")))
    cohorts = activity.groupBy("cohort_month", "activity_month").agg(
        F.count(F.lit(1)).alias("active_customers"), F.sum("monthly_revenue").alias("revenue")
    )
    # Every customer is active in its cohort month, so that row holds the cohort size.
    size = F.max(F.when(F.col("activity_month") == F.col("cohort_month"), F.col("active_customers"))).over(
        W.partitionBy("cohort_month")
    )
    total = months_between_starts(F.col("cohort_month"), F.col("activity_month"))
    return cohorts.withColumn("cohort_size", size).select(
        "cohort_month", "activity_month",
        (total % 12).alias("months_since_acquisition"),
        total.alias("months_total"),
        "cohort_size", "active_customers",
        rnd(100.0 * safe_divide(F.col("active_customers"), F.col("cohort_size")), 1).alias("retention_pct"),
        dbl(F.col("revenue")).alias("cohort_revenue"),
        rnd(safe_divide(F.col("revenue"), F.col("active_customers")), 2).alias("revenue_per_active_customer"),
    )


def most_frequent(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value per key, lowest value on ties: counted first, then max_by."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key, "n").agg(F.min(value).alias(name))
    return best.groupBy(key).agg(F.max_by(name, "n").alias(name))


def dim_customers(orders: DataFrame) -> DataFrame:
    """Lifetime value, favourite category and city, and segment per customer.

    The lines are summed per (customer, category, city) once; grouping sets then run over those sums: per customer, per
    (customer, category) and per (customer, city). The two modes are picked among a customer's few group rows.
    """
    keys = ["customer_id", "category", "city"]
    cells = orders.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("total_amount").alias("revenue"),
        F.min("ordered_at").alias("first_at"),
        F.max("ordered_at").alias("last_at"),
        F.count_if("is_completed").alias("done"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
    )
    sets = cells.groupingSets([["customer_id"], ["customer_id", "category"], ["customer_id", "city"]], *keys).agg(
        F.grouping_id().alias("g"), *(F.sum(c).alias(c) for c in ("n", "revenue", "done", "cancelled")),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )
    # Grouping ids: 3 = customer, 1 = (customer, category), 2 = (customer, city).
    per_customer, by_category, by_city = F.col("g") == 3, F.col("g") == 1, F.col("g") == 2

    def whole(c: str) -> Column:
        return F.max(F.when(per_customer, F.col(c)))

    def mode_of(c: str, when: Column) -> Column:
        return F.min(F.when(when & F.col(c).isNotNull(), F.struct(-F.col("n"), F.col(c).alias("v"))))["v"]

    return sets.groupBy("customer_id").agg(
        whole("n").alias("total_orders"), whole("revenue").alias("revenue"),
        whole("first_at").alias("first_order_at"), whole("last_at").alias("last_order_at"),
        mode_of("category", by_category).alias("favorite_category"), mode_of("city", by_city).alias("preferred_city"),
        whole("done").alias("completed_orders"), whole("cancelled").alias("cancelled_orders"),
    ).select(
        "customer_id", "total_orders",
        dbl(F.col("revenue")).alias("total_revenue"),
        rnd(safe_divide(F.col("revenue"), F.col("total_orders")), 2).alias("avg_order_value"),
        "first_order_at", "last_order_at", "favorite_category", "preferred_city",
        "completed_orders", "cancelled_orders",
        rnd(100.0 * safe_divide(F.col("completed_orders"), F.col("total_orders")), 1).alias("completion_rate_pct"),
        F.when(F.col("revenue") > 1000, "VIP").when(F.col("revenue") > 300, "Regular")
        .otherwise("Occasional").alias("customer_segment"),
    )


def dim_taxi_zones(trips: DataFrame) -> DataFrame:
    """Pickup and dropoff usage per zone, zones seen on either side kept.

    Each trip is dealt to its two zones in the scan stage and summed there, so one pass and one
    shuffle give what a full outer join of two aggregates would.
    """
    ends = F.array(
        F.struct(F.col("pu_location_id").alias("location_id"), F.col("total_amount").alias("paid"), F.lit(1).alias("p")),
        F.struct(F.col("do_location_id").alias("location_id"), F.lit(None).cast("decimal(18,2)").alias("paid"), F.lit(0).alias("p")))
    zones = trips.select(F.inline(ends)).filter(F.col("location_id").isNotNull()).groupBy("location_id").agg(
        F.count_if(F.col("p") == 1).alias("pickup_count"), F.count_if(F.col("p") == 0).alias("dropoff_count"),
        F.coalesce(rnd(ratio_sum(F.col("paid")), 2), F.lit(0.0)).alias("avg_fare"),
        F.coalesce(dbl(F.sum("paid")), F.lit(0.0)).alias("total_revenue"))
    total = F.col("pickup_count") + F.col("dropoff_count")
    tier = (
        F.when(F.col("location_id").isin(AIRPORT_ZONES), "Airport")
        .when(total > 100000, "High Traffic").when(total > 10000, "Medium Traffic").otherwise("Low Traffic")
    )
    return zones.select(
        "location_id", "pickup_count", "dropoff_count", total.alias("total_trips"),
        "avg_fare", "total_revenue", tier.alias("zone_tier"),
    )


def _trip_roles(trips: DataFrame) -> DataFrame:
    """Each trip under its pickup and its dropoff zone, in one scan; one row when they are the same."""
    zones = F.array_distinct(F.array("pu_location_id", "do_location_id"))
    same = F.col("pu_location_id") == F.col("do_location_id")
    return trips.withColumn("roles", F.when(same, 2).otherwise(1)).withColumn("location_id", F.explode(zones))


def dim_locations(trips: DataFrame) -> DataFrame:
    """Pickup and dropoff roles together; sums count a trip once per role, num_trips once."""
    def role_sum(c: str) -> Column:
        return dbl(F.sum(F.col(c) * F.col("roles")))

    return _trip_roles(trips).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("num_trips"),
        F.sum(F.when(F.col("is_airport_trip"), F.col("roles")).otherwise(0)).alias("num_airport_trips"),
        role_sum("trip_distance_miles").alias("total_distance_miles"),
        role_sum("fare_amount").alias("total_fare_amount"),
        role_sum("tip_amount").alias("total_tip_amount"),
        role_sum("total_amount").alias("total_total_amount"),
    )


def dim_geography(trips: DataFrame, orders: DataFrame) -> DataFrame:
    """Trips per zone and orders per city in one table, the other source's columns null."""
    def per_place(df: DataFrame, place: Column, key: str, amount: str, n: str, total: str) -> DataFrame:
        # One row per key first, so the count needs no expanded rows.
        keys = df.groupBy(place, key).agg(F.sum(amount).alias(total))
        return keys.groupBy(keys.columns[0]).agg(F.count(key).alias(n), F.sum(total).alias(total))

    left = per_place(trips, F.col("pu_location_id").alias("location_id"), "trip_id", "fare_amount", "num_trips", "total_trip_amount")
    right = per_place(orders, F.col("city"), "order_id", "total_amount", "num_orders", "total_order_amount")
    # Places without a name on both sides are one row.
    return left.unionByName(right, allowMissingColumns=True).groupBy("location_id", "city").agg(
        F.coalesce(F.sum("num_orders"), F.lit(0)).alias("num_orders"), F.coalesce(F.sum("num_trips"), F.lit(0)).alias("num_trips"),
        dbl(F.sum("total_order_amount")).alias("total_order_amount"), dbl(F.sum("total_trip_amount")).alias("total_trip_amount"))


def dim_payment_types(raw_trips: DataFrame) -> DataFrame:
    code = F.col("payment_type")
    text = F.when(F.lit(False), None)
    for number, label in PAYMENTS.items():
        text = text.when(code == number, label)
    return raw_trips.select("payment_type").distinct().select(
        "payment_type", text.when(code == 5, "Unknown").otherwise("Other").alias("payment_type_description")
    )


def dim_payments(trips: DataFrame, orders: DataFrame) -> DataFrame:
    """Payment methods of trips, then the single method of commerce orders."""
    a = trips.filter(F.col("payment_method").isNotNull()).select(F.col("payment_method").alias("payment_type")).distinct()
    b = orders.filter(F.col("order_id").isNotNull()).select(F.lit("Credit Card").alias("payment_type")).distinct()
    return a.unionByName(b).select("payment_type", F.col("payment_type").alias("payment_type_description"))


def dim_products(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("product_name").alias("product_id"), "product_name", F.col("category").alias("product_category")
    ).distinct()


def dim_vendors(trips: DataFrame) -> DataFrame:
    return trips.select(F.col("vendor_name").alias("vendor_id"), "vendor_name").distinct()


def dim_ratecodes(raw_trips: DataFrame, column: str = "vendor_id") -> DataFrame:
    """Distinct values of one code column."""
    return raw_trips.select(F.col(column).alias("rate_code")).distinct()


def dim_time(trips: DataFrame, orders: DataFrame) -> DataFrame:
    """Calendar parts of every trip pickup and every order time."""
    at = F.col("at")
    both = trips.select(F.col("pickup_at").alias("at")).unionByName(orders.select(F.col("ordered_at").alias("at")))
    return both.select(
        F.year(at).alias("year"), F.month(at).alias("month"), F.day(at).alias("day"), F.hour(at).alias("hour"),
        F.minute(at).alias("minute"), F.quarter(at).alias("quarter"), F.weekofyear(at).alias("week"),
        dow(at).alias("day_of_week"),
    )


def daily_metrics(lines: DataFrame) -> DataFrame:
    """Closed orders per day and region: (day, region, order_id, customer_id, revenue, profit) -> metrics."""
    per_order = lines.groupBy("day", "region", "order_id", "customer_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit")
    )
    per_customer = per_order.groupBy("day", "region", "customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit")
    )
    return per_customer.groupBy("day", "region").agg(
        F.sum("orders").alias("total_orders"),
        dbl(F.sum("revenue")).alias("total_revenue"),
        dbl(F.sum("profit")).alias("total_profit"),
        F.count(F.lit(1)).alias("customers"),
        rnd(safe_divide(F.sum("revenue"), F.sum("orders")), 2).alias("avg_order_value"),
    )


def customer_ltv(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with order count, lifetime value and last order; orders pre-aggregated before the join."""
    spent = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_total").alias("ltv"), F.max("created_at").alias("last_order_at")
    )
    return customers.join(spent, "customer_id", "left").select(
        "customer_id",
        F.concat_ws(" ", "name", "segment").alias("full_name"),
        F.coalesce("n", F.lit(0)).alias("total_orders"),
        dbl(F.coalesce("ltv", F.lit(0))).alias("lifetime_value"),
        "last_order_at",
    )


def fact_orders(items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines with customer segment, calendar keys and gross profit."""
    at = F.col("o.created_at")
    line_total = F.col("i.quantity") * F.col("i.unit_price")
    return (
        items.alias("i")
        .join(orders.alias("o"), F.col("i.order_id") == F.col("o.id"))
        .join(products.alias("p"), F.col("i.product_id") == F.col("p.id"))
        .join(customers.alias("c"), F.col("o.customer_id") == F.col("c.customer_id"))
        .select(
            F.col("o.id").alias("order_id"), F.col("c.customer_id"), F.col("c.segment"),
            F.col("p.category"), F.col("i.quantity"),
            F.year(at).alias("order_year"), F.month(at).alias("order_month"), F.quarter(at).alias("order_quarter"),
            dbl(line_total).alias("line_total"),
            dbl(line_total - F.col("p.cost") * F.col("i.quantity")).alias("gross_profit"),
        )
    )
