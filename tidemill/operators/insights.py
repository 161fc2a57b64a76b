"""Insight statistics over the marts, drill-downs, and the deterministic insight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.constants import INSIGHTS
from tidemill.functions.exprs import back, dbl, decode, ratio_sum, rnd, safe_divide, share_pct

WINDOW_DAYS = {"24h": 1, "7d": 7, "30d": 30}
# Severity order of the insight list.
SEVERITY_ORDER = {"anomaly": 0, "warning": 1, "opportunity": 2, "info": 3}


def _since(df: DataFrame, day: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(day) >= F.to_date(as_of) - F.lit(days))


def trip_stats(trips: DataFrame, as_of: Column) -> DataFrame:
    """7-day and 24-hour trip totals as one row."""
    week = _since(trips, "pickup_date", as_of, 7).withColumn("today", F.col("pickup_date") >= F.to_date(as_of) - 1)
    today = F.col("today")
    return week.agg(
        F.count("*").alias("total_trips"), rnd(ratio_sum(F.col("total_amount")), 2).alias("avg_fare"),
        dbl(F.sum("total_amount")).alias("total_revenue"), F.count_if("is_airport_trip").alias("airport_trips"),
        share_pct(F.col("is_airport_trip")).alias("airport_pct"), F.count_if(today).alias("trips_24h"),
        dbl(F.sum(F.when(today, F.col("total_amount")))).alias("revenue_24h"))


def peak_hours(trips: DataFrame, as_of: Column, n: int = 3) -> DataFrame:
    hours = _since(trips, "pickup_date", as_of, 7).groupBy("pickup_hour").agg(F.count("*").alias("trips"))
    return hours.orderBy(F.desc("trips"), "pickup_hour").limit(n)


def payment_split(trips: DataFrame, as_of: Column) -> DataFrame:
    return _since(trips, "pickup_date", as_of, 7).groupBy("payment_method").agg(F.count("*").alias("trips"))


def commerce_totals(summary: DataFrame, as_of: Column) -> DataFrame:
    return _since(summary, "order_date", as_of, 7).agg(
        rnd(F.sum(_money("total_revenue")), 2).alias("revenue"), F.sum("order_count").alias("orders"),
        rnd(ratio_sum(_money("avg_order_value")), 2).alias("avg_order"))


def top_categories(summary: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    by = _since(summary, "order_date", as_of, 30).groupBy("category").agg(
        rnd(F.sum(_money("total_revenue")), 2).alias("revenue"), F.sum("order_count").alias("orders"))
    return by.orderBy(F.desc("revenue"), "category").limit(n)


def top_cities(summary: DataFrame, as_of: Column, n: int = 3) -> DataFrame:
    by = _since(summary, "order_date", as_of, 7).groupBy("city").agg(rnd(F.sum(_money("total_revenue")), 2).alias("revenue"))
    return by.orderBy(F.desc("revenue"), "city").limit(n)


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def segments(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_segment").agg(
        F.count("*").alias("customers"), rnd(ratio_sum(_money("total_revenue")), 2).alias("avg_ltv"))


def ltv_summary(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count("*").alias("total_customers"), rnd(ratio_sum(_money("total_revenue")), 2).alias("avg_ltv"),
                         F.max("total_revenue").alias("max_ltv"))


def tier_breakdown(zones: DataFrame) -> DataFrame:
    return zones.groupBy("zone_tier").agg(F.count("*").alias("zones"), F.sum("total_trips").alias("trips"))


def top_zones(zones: DataFrame, n: int = 5) -> DataFrame:
    return zones.orderBy(F.desc("total_trips"), "location_id").limit(n).select("location_id", "total_trips", "avg_fare")


def run_health(runs: DataFrame, as_of: Column) -> DataFrame:
    recent = runs.filter(F.col("started_at") >= back(as_of, "24 hours"))
    return recent.groupBy("pipeline_name", "status").agg(F.count("*").alias("runs"), F.max("started_at").alias("last_run"))


def drill_down(table: str, df: DataFrame, window: str, as_of: Column, n: int = 30) -> DataFrame:
    """The supporting table of an insight: 30 newest groups for trips and commerce, all groups for the others."""
    days = WINDOW_DAYS.get(window, 7)
    if table == "trips":
        by = _since(df, "pickup_date", as_of, days).groupBy("pickup_date").agg(
            F.count("*").alias("trips"), dbl(F.sum("total_amount")).alias("revenue"))
        return by.orderBy(F.desc("pickup_date")).limit(n)
    if table == "ecommerce":
        by = _since(df, "order_date", as_of, days).groupBy("order_date", "category").agg(
            rnd(F.sum(_money("total_revenue")), 2).alias("revenue"))
        return by.orderBy(F.desc("order_date"), "category").limit(n)
    if table == "customers":
        return segments(df)
    if table == "zones":
        return df.groupBy("zone_tier").agg(F.count("*").alias("zones"), F.sum("total_trips").alias("total_trips"),
                                           rnd(ratio_sum(_money("avg_fare")), 2).alias("avg_fare"))
    raise ValueError(f"no drill-down for {table}")


def _rounded(c: Column, digits: int) -> Column:
    return F.round(c.cast("decimal(38,6)"), digits).cast(f"decimal(18,{digits})")


def insight_rows(trips: DataFrame, commerce: DataFrame, customers: DataFrame) -> DataFrame:
    """Ten insight rows filled from the one-row statistics, with their severity rank."""
    vip = customers.filter(F.col("customer_segment") == "VIP").agg(
        F.count("*").alias("vip"), F.coalesce(ratio_sum(_money("total_revenue")), F.lit(0.0)).alias("vip_ltv"))
    zero = F.lit(0.0)
    # Each side is a single aggregate row.
    one = trips.crossJoin(F.broadcast(commerce)).crossJoin(F.broadcast(vip)).select(
        F.coalesce("total_revenue", zero).alias("revenue"), "total_trips", F.coalesce("airport_pct", zero).alias("airport"),
        F.coalesce("revenue", zero).alias("sales"), F.coalesce("orders", F.lit(0)).alias("orders"), "vip", "vip_ltv")
    shown = {
        "rev": F.format_number(_rounded(F.col("revenue"), 0), 0),
        "trips": F.format_number("total_trips", 0),
        "fare": _rounded(F.col("revenue") / F.greatest(F.col("total_trips"), F.lit(1)), 2).cast("string"),
        "apt": _rounded(F.col("airport"), 1).cast("string"),
        "eco_rev": F.format_number(_rounded(F.col("sales"), 0), 0),
        "eco_ord": F.format_number("orders", 0),
        "vip": F.col("vip").cast("string"),
        "vip_ltv": _rounded(F.col("vip_ltv"), 2).cast("string"),
    }

    def fill(template: str) -> Column:
        text = F.lit(template)
        for name, value in shown.items():
            if f"{{{name}}}" in template:
                text = F.replace(text, F.lit(f"{{{name}}}"), value)
        return text

    by_airport = F.when(F.col("airport") > 10, "opportunity").otherwise("info")
    rows = F.array(*[
        F.struct(fill(title).alias("title"), fill(insight).alias("insight"),
                 (by_airport if severity == "by_airport_share" else F.lit(severity)).alias("severity"),
                 fill(metric).alias("metric"), F.lit(window).alias("time_window"), F.lit(table).alias("table_name"))
        for title, insight, severity, metric, window, table in INSIGHTS
    ])
    return one.select(F.inline(rows)).withColumn("severity_rank", decode(F.col("severity"), SEVERITY_ORDER, 3))


def cached_insights(insights: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    """Insights younger than an hour, most severe and newest first."""
    fresh = insights.filter(F.col("generated_at") > back(as_of, "1 hours"))
    return fresh.orderBy("severity_rank", F.desc("generated_at"), "title").limit(n)


def failure_share(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline_name").agg(share_pct(F.col("status") == "failed", 2).alias("failure_rate"))


def slowest(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "success").groupBy("pipeline_name").agg(
        rnd(ratio_sum(F.col("duration_seconds")), 2).alias("avg_duration"))


def longest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("duration_seconds"), "run_no").limit(n).select("pipeline_name", "id", "duration_seconds")


def totals_by(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Rows and amount per group, with the group's share of the total."""
    total = df.agg(F.sum(amount)).scalar()
    return df.groupBy(*keys).agg(F.count("*").alias("orders"), F.sum(amount).alias("amount")).select(
        *keys, "orders", dbl(F.col("amount")).alias("amount"), rnd(100.0 * safe_divide(F.col("amount"), total), 2).alias("share_pct"))
