"""Analyst questions as named, parameterised queries over trips, orders, runs and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.exprs import back, dbl, ratio_sum, rnd, safe_divide, share_pct
from tidemill.functions.ordered import longest_streaks, with_next
from tidemill.functions.series import global_rank
from tidemill.operators.anomalies import classify_error


def scalar_totals(df: DataFrame, amount: str, condition: Column) -> DataFrame:
    """Count, sum, mean, min, max of an amount, and the count for which a condition holds."""
    a = F.col(amount)
    return df.agg(F.count("*").alias("rows"), dbl(F.sum(a)).alias("total"), rnd(ratio_sum(a), 2).alias("mean"),
                  dbl(F.min(a)).alias("low"), dbl(F.max(a)).alias("high"), F.count_if(condition).alias("matching"))


def trend(df: DataFrame, at: str, unit: str, amount: str) -> DataFrame:
    """Rows and amount per calendar period."""
    period = F.to_date(F.date_trunc(unit, F.col(at)))
    return df.groupBy(period.alias("period")).agg(F.count("*").alias("rows"), F.sum(amount).alias("amount"))


def top_routes(trips: DataFrame, min_trips: int, n: int = 10) -> DataFrame:
    """Busiest pickup-dropoff pairs with more than min_trips trips."""
    routes = trips.groupBy("pu_location_id", "do_location_id").agg(
        F.count("*").alias("trips"), rnd(ratio_sum(F.col("total_amount")), 2).alias("avg_fare"))
    return routes.filter(F.col("trips") > min_trips).orderBy(F.desc("trips"), "pu_location_id", "do_location_id").limit(n)


def without_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return customers.join(orders.select("customer_id"), "customer_id", "left_anti")


def inactive(orders: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Customers whose last order is more than ``days`` old."""
    last = orders.groupBy("customer_id").agg(F.max("created_at").alias("last_order_at"))
    return last.filter(F.col("last_order_at") < back(as_of, f"{days} days"))


def active_every(orders: DataFrame, year: int, unit: str = "month") -> DataFrame:
    """Customers with an order in every month (or quarter) of a year."""
    periods = {"month": (F.month, 12), "quarter": (F.quarter, 4)}[unit]
    seen = orders.filter(F.year("created_at") == year).select("customer_id", periods[0]("created_at").alias("p")).distinct()
    return seen.groupBy("customer_id").agg(F.count("*").alias("periods")).filter(F.col("periods") == periods[1])


def above_average(df: DataFrame, value: str) -> DataFrame:
    mean = df.agg(F.avg(dbl(F.col(value)))).scalar()
    return df.filter(dbl(F.col(value)) > mean)


def above_group_average(df: DataFrame, group: str, value: str) -> DataFrame:
    means = df.groupBy(group).agg(ratio_sum(F.col(value)).alias("group_mean"))
    return df.join(means, group).filter(dbl(F.col(value)) > F.col("group_mean"))


def outliers(df: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows more than ``sigmas`` sample deviations above the mean."""
    v = dbl(F.col(value))
    limit = df.agg(F.avg(v) + sigmas * F.stddev_samp(v)).scalar()
    return df.filter(v > limit)


def orders_of_top_customers(orders: DataFrame, n: int = 10) -> DataFrame:
    top = orders.groupBy("customer_id").agg(F.sum("order_total").alias("spend")).orderBy(F.desc("spend"), "customer_id").limit(n)
    return orders.join(top.select("customer_id"), "customer_id", "left_semi")


def tip_share(trips: DataFrame) -> DataFrame:
    """Per payment method: share of trips with a tip, ratio of mean tip to mean fare."""
    return trips.groupBy("payment_method").agg(
        share_pct(F.col("tip_amount") > 1, 2).alias("tipped_pct"),
        rnd(safe_divide(F.sum("tip_amount"), F.sum("fare_amount")), 4).alias("tip_to_fare"))


def product_ranks(items: DataFrame) -> DataFrame:
    """Every product ranked by revenue."""
    revenue = items.groupBy("product_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(20,2)").alias("revenue"))
    return global_rank(revenue, "revenue")


def busiest(df: DataFrame, part: Column, n: int = 1) -> DataFrame:
    """The period (hour, day, weekday) with the most rows."""
    return df.groupBy(part.alias("period")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "period").limit(n)


def success_rates(runs: DataFrame) -> DataFrame:
    """Success % per flow and its rank by failure %; the ranked table has one row per flow."""
    rates = runs.groupBy("pipeline_name").agg(
        F.count("*").alias("runs"), share_pct(F.col("status") == "success", 2).alias("success_pct"),
        share_pct(F.col("status") == "failed", 2).alias("failure_pct"), F.sum("records_loaded").alias("records_loaded"))
    return global_rank(rates, "failure_pct", "failure_rank")


def long_failure_streaks(runs: DataFrame, more_than: int = 5) -> DataFrame:
    """Streaks of more than n consecutive failures of a flow."""
    flagged = runs.select("pipeline_name", "started_at", "run_no", (F.col("status") == "failed").alias("failed"))
    return longest_streaks(flagged, ["pipeline_name"], "started_at", "run_no", "failed").filter(F.col("length") > more_than)


def before_after(runs: DataFrame, cut: Column) -> DataFrame:
    """Failure % and mean duration per flow before and from a cut-over time."""
    early = F.col("started_at") < cut
    failed = F.col("status") == "failed"

    def side(when: Column, name: str) -> list[Column]:
        return [
            rnd(100.0 * safe_divide(F.count_if(when & failed), F.count_if(when)), 2).alias(f"failure_pct_{name}"),
            rnd(ratio_sum(F.when(when, F.col("duration_seconds"))), 2).alias(f"avg_duration_{name}"),
        ]

    return runs.groupBy("pipeline_name").agg(*side(early, "before"), *side(~early, "after"))


def followed_by(incidents: DataFrame, first: str, second: str) -> DataFrame:
    """Flows where an incident of one type is immediately followed by one of another type."""
    ahead = with_next(incidents.select("pipeline_name", "detection_at", "incident_id", "anomaly_type"),
                      ["pipeline_name"], "detection_at", "incident_id", {"next_type": "anomaly_type", "next_at": "detection_at"})
    hits = ahead.filter((F.col("anomaly_type") == first) & (F.col("next_type") == second))
    return hits.select("pipeline_name", "incident_id", "detection_at", "next_at")


def consecutive_days(incidents: DataFrame, keys: list[str], more_than: int = 3) -> DataFrame:
    """Keys with incidents on more than n consecutive days; the window sees one row per key and day."""
    days = incidents.select(*keys, F.to_date("detection_at").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy(*keys).orderBy("day")))
    return days.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min("day").alias("first_day"), F.count("*").alias("days")).drop("_island").filter(F.col("days") > more_than)


def slower_than_last_week(runs: DataFrame, as_of: Column, factor: float = 1.5) -> DataFrame:
    """Flows whose mean duration of the last 7 days exceeds the 7 days before by the factor."""
    at, d = F.col("started_at"), F.col("duration_seconds")
    recent = runs.filter(at >= back(as_of, "14 days")).withColumn("as_of", as_of)
    this = at >= back(F.col("as_of"), "7 days")
    both = recent.groupBy("pipeline_name").agg(
        ratio_sum(F.when(this, d)).alias("this_week"), ratio_sum(F.when(~this, d)).alias("last_week"))
    return both.filter(F.col("this_week") > F.col("last_week") * factor).select(
        "pipeline_name", rnd(F.col("this_week"), 2).alias("this_week"), rnd(F.col("last_week"), 2).alias("last_week"))


def failure_correlation(runs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per flow: correlation over days of failed records and incidents."""
    failed = runs.groupBy("pipeline_name", F.to_date("started_at").alias("day")).agg(F.sum("records_failed").alias("f"))
    found = incidents.groupBy("pipeline_name", F.to_date("detection_at").alias("day")).agg(F.count("*").alias("n"))
    daily = failed.join(found, ["pipeline_name", "day"], "left")
    return daily.groupBy("pipeline_name").agg(
        rnd(F.corr(dbl(F.col("f")), dbl(F.coalesce("n", F.lit(0)))), 4).alias("correlation"), F.count("*").alias("days"))


def new_customer_revenue(orders: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Customers whose first order is within the last days, and what they spent."""
    per_customer = orders.groupBy("customer_id").agg(F.min("created_at").alias("first_at"), F.sum("order_total").alias("spend"))
    new = per_customer.filter(F.col("first_at") >= back(as_of, f"{days} days"))
    return new.agg(F.count("*").alias("new_customers"), dbl(F.coalesce(F.sum("spend"), F.lit(0))).alias("revenue"))


def failure_rate_by(df: DataFrame, group: str, failed: Column) -> DataFrame:
    """Share of failed rows per group, and its rank from the lowest; one row per group is ranked."""
    rates = df.groupBy(group).agg(F.count("*").alias("rows"), share_pct(failed, 2).alias("failure_pct"))
    return global_rank(rates.withColumn("_kept", -F.col("failure_pct")), "_kept", "rank").drop("_kept")


def schema_errors_by_source(runs: DataFrame) -> DataFrame:
    """Failed runs per source type whose message means a changed schema."""
    drift = runs.filter((F.col("status") == "failed") & (classify_error(F.col("error_message")) == "SCHEMA_DRIFT"))
    return drift.groupBy("source_type").agg(F.count("*").alias("drift_runs"))


def heal_rank(incidents: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Flows ranked by the share of incidents of the last days that healed."""
    recent = incidents.filter(F.col("detection_at") >= back(as_of, f"{days} days"))
    rates = recent.groupBy("pipeline_name").agg(
        share_pct(F.col("outcome").isin("approved", "auto_healed"), 2).alias("heal_pct"), F.count("*").alias("incidents"))
    return global_rank(rates, "heal_pct", "heal_rank")


