"""Staging models: cleaned, typed views over raw trips and raw commerce orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.constants import AIRPORT_ZONES
from tidemill.functions.exprs import decode, dow

VENDORS = {1: "Creative Mobile", 2: "VeriFone"}
PAYMENTS = {1: "Credit Card", 2: "Cash", 3: "No Charge", 4: "Dispute"}
WAREHOUSE_PAYMENTS = {1: "credit_card", 2: "cash", 3: "no_charge", 4: "dispute"}


def _money2(c):
    return F.round(c.cast("decimal(38,6)"), 2).cast("decimal(18,2)")


def stg_trips(raw: DataFrame) -> DataFrame:
    """Trips with both times, a positive fare and a duration of 60..7200 seconds."""
    pickup, dropoff = F.col("pickup_datetime"), F.col("dropoff_datetime")
    micros = F.timestamp_diff("MICROSECOND", pickup, dropoff)
    passengers = F.col("passenger_count")
    bad_count = passengers.isNull() | F.isnan(passengers) | (passengers < 0) | (passengers > 9)
    return raw.filter(
        pickup.isNotNull() & dropoff.isNotNull() & (dropoff > pickup)
        & (F.coalesce("trip_distance", F.lit(0.0)) >= 0)
        & (F.coalesce("total_amount", F.lit(0.0)) > 0)
        & micros.between(60_000_000, 7_200_000_000)
    ).select(
        F.col("id").cast("bigint").alias("trip_id"),
        decode(F.col("vendor_id"), VENDORS, "Unknown").alias("vendor_name"),
        pickup.alias("pickup_at"),
        dropoff.alias("dropoff_at"),
        F.hour(pickup).alias("pickup_hour"),
        dow(pickup).alias("pickup_day_of_week"),
        _money2(micros / F.lit(60_000_000.0)).alias("trip_duration_min"),
        F.coalesce("trip_distance", F.lit(0.0)).cast("decimal(18,2)").alias("trip_distance_miles"),
        F.when(bad_count, F.lit(1)).otherwise(passengers.cast("int")).alias("passenger_count"),
        "pu_location_id",
        "do_location_id",
        decode(F.col("payment_type"), PAYMENTS, "Unknown").alias("payment_method"),
        *[_money2(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("fare_amount", "tip_amount", "total_amount")],
        (F.col("pu_location_id").isin(AIRPORT_ZONES) | F.col("do_location_id").isin(AIRPORT_ZONES))
        .alias("is_airport_trip"),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    """Commerce orders with an id and a positive total, text trimmed, calendar keys added."""
    status, at = F.lower(F.trim("status")), F.col("created_at")
    return raw.filter(F.col("order_id").isNotNull() & (F.col("total_amount") > 0)).select(
        F.col("id").cast("bigint").alias("order_key"),
        "order_id",
        F.col("customer_id").cast("int").alias("customer_id"),
        F.col("product_id").cast("int").alias("product_id"),
        F.trim("product_name").alias("product_name"),
        F.trim("category").alias("category"),
        _money2(F.col("unit_price")).alias("unit_price"),
        F.col("quantity").cast("int").alias("quantity"),
        F.round(F.col("total_amount"), 2).cast("decimal(18,2)").alias("total_amount"),
        status.alias("status"),
        status.isin("delivered", "shipped").alias("is_completed"),
        F.trim("city").alias("city"),
        F.trim(F.coalesce("country", F.lit("Unknown"))).alias("country"),
        at.alias("ordered_at"),
        F.year(at).alias("order_year"),
        F.month(at).alias("order_month"),
        dow(at).alias("order_dow"),
        F.date_format(at, "yyyy-MM").alias("order_month_key"),
    )


def warehouse_trips(raw: DataFrame) -> DataFrame:
    """Trips in the warehouse layout: payment code as text, amounts as float."""
    return raw.select(
        F.concat(F.lit("trip_"), F.col("id").cast("string")).alias("trip_id"),
        "pickup_datetime",
        "dropoff_datetime",
        F.col("passenger_count").cast("int").alias("passenger_count"),
        *[F.col(c).cast("float").alias(c) for c in ("trip_distance", "fare_amount", "tip_amount", "total_amount")],
        decode(F.col("payment_type"), WAREHOUSE_PAYMENTS, "unknown").alias("payment_type"),
    )
