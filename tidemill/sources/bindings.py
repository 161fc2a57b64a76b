"""Domain tables (runs, trips, orders, incidents, query log, ...) derived from the given tables.

Every binding is a narrow projection of whole input tables, so filters and column
pruning reach the Parquet scan through it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.constants import ANOMALY_TYPES, ERROR_SIGNATURES, SLA_SECONDS
from tidemill.functions.exprs import decode, pick
from tidemill.session import pin_semantics
from tidemill.sources.readers import spread

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
              "conversations").split()
PIPELINES = list(SLA_SECONDS)
SOURCE_TYPES = ["csv", "postgresql", "rest_api", "google_sheets"]
STRATEGIES = ["retry", "rollback", "schema_patch"]
OUTCOMES = ["approved", "auto_healed", "rejected", "expired"]
INCIDENT_STATES = ["open", "pending_approval", "auto_healed", "resolved", "rejected"]
# A message around every fourth signature, and one without any.
ERROR_MESSAGES = [f"step {i} ended: {text} (see log {i})" for i, (text, _) in enumerate(ERROR_SIGNATURES[::4])] + [
    "the run ended and said nothing more"]
ORDER_STATUS = {"F": "delivered", "O": "shipped", "P": "cancelled"}
SHOP_STATUS = {"F": "completed", "O": "shipped", "P": "cancelled"}

# Statement shapes of the query log; {u} becomes the user's number.
STATEMENTS = [
    "SELECT * FROM sales.orders_{u}",
    "SELECT order_id, total FROM sales.orders_{u} WHERE total > 10 LIMIT 50",
    "select distinct city, count(*) from sales.customers_{u} group by city",
    "SELECT a.id FROM sales.orders_{u} a, sales.items_{u} b WHERE a.id = b.order_id",
    "SELECT id FROM sales.orders_{u} WHERE customer_id IN (SELECT id FROM sales.customers_{u})",
    "SELECT id FROM sales.orders_{u} WHERE status = 'open' OR status = 'late' LIMIT 20",
    "SELECT id FROM sales.customers_{u} WHERE name LIKE '%son' LIMIT 20",
    "SELECT id FROM sales.orders_{u} WHERE UPPER(status) = 'OPEN' LIMIT 5",
    "SELECT id, (SELECT MAX(total) FROM sales.orders_{u}) AS top FROM sales.customers_{u} LIMIT 5",
    "SELECT region, SUM(total) FROM sales.orders_{u} GROUP BY region ORDER BY region",
    "SELECT id FROM sales.orders_{u} WHERE placed_at < NOW() LIMIT 9",
    "SELECT * EXCEPT (note) FROM `shop.orders_{u}` LIMIT 100",
    "SELECT table_name FROM SVV_TABLE_INFO WHERE owner = 'u{u}' LIMIT 10",
    "SELECT id FROM sales.orders_{u} WHERE customer_id = '{u}' LIMIT 10",
    "SELECT id FROM read_parquet('s3://lake/orders_{u}.parquet') LIMIT 10",
    "DELETE FROM sales.orders_{u} WHERE id = 7",
    "SELECT o.id, ROW_NUMBER() OVER (PARTITION BY o.city ORDER BY o.id) AS n FROM staging.orders_{u} o JOIN marts.geo_{u} g ON o.city = g.city JOIN raw.zip_{u} z ON z.city = g.city JOIN raw.st_{u} s ON s.zip = z.zip JOIN raw.own_{u} w ON w.st = s.st WHERE o.id > 3",
    "SELECT city, COUNT(*) FROM marts.orders_{u} GROUP BY city HAVING COUNT(*) > 5 LIMIT 10",
]
DIALECTS = ["postgresql", "snowflake", "bigquery", "redshift", "mysql"]
CONTEXTS = ["dbt:staging.orders", "dbt:mart.sales", "analyst", "api"]

# Column names of the data catalog: (name, type).
CATALOG_COLUMNS = [
    ("id", "integer"), ("name", "character varying"), ("email", "character varying"),
    ("phone", "character varying"), ("address", "text"), ("date_of_birth", "date"),
    ("customer_id", "integer"), ("order_total", "numeric"), ("created_at", "timestamp"),
    ("order_id", "integer"), ("card_number", "character varying"), ("amount", "numeric"),
    ("price", "numeric"), ("user_email", "character varying"), ("ip_address", "character varying"),
    ("old_passwd", "character varying"), ("social_security_no", "character varying"),
    ("Full_Name", "character varying"), ("salary", "numeric"), ("latitude", "double precision"),
    ("device_id", "character varying"), ("gender", "character varying"), ("tax_id", "character varying"),
    ("passport", "character varying"),
]

# Description registry of some catalog columns: (name, description, example).
CATALOG_NOTES = [
    ("email", "contact address", "a@example.org"),
    ("order_total", "order value", "12.50"),
    ("created_at", "creation time", "2024-01-01"),
    ("customer_id", "buyer", "17"),
]


class Tables:
    """Given tables by name (``t.orders``) and domain tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_semantics(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.raw(name)
        self.__dict__[name] = df
        return df

    @cached_property
    def _events_k(self) -> DataFrame:
        return self.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    @cached_property
    def as_of(self) -> Column:
        """Newest event time, as a scalar subquery."""
        return self.events.agg(F.max("ts")).scalar()

    @cached_property
    def orders_as_of(self) -> Column:
        return self.orders.agg(F.max("o_orderdate")).scalar()

    @cached_property
    def runs(self) -> DataFrame:
        failed = F.col("event_type") == "error"
        cents = F.round(F.col("value") * 100).cast("bigint")
        bad = F.when(F.col("k") >= 98, F.col("k") * 10).otherwise(F.col("k"))
        micros = F.round(F.col("value") * 6000000).cast("bigint")
        return self._events_k.select(
            F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("id"),
            F.col("event_id").alias("run_no"),
            "user_id",
            pick(PIPELINES, F.col("user_id") % len(PIPELINES)).alias("pipeline_name"),
            pick(SOURCE_TYPES, F.col("user_id") % len(SOURCE_TYPES)).alias("source_type"),
            (cents + bad).alias("records_ingested"),
            F.when(failed | (F.col("k") < 4), F.lit(0).cast("bigint")).otherwise(cents).alias("records_loaded"),
            bad.alias("records_failed"),
            (F.col("k") / F.lit(250.0)).alias("null_rate"),
            ((F.col("event_id") * 7 % 100) / F.lit(400.0)).alias("duplicate_rate"),
            F.when(failed, "failed").otherwise("success").alias("status"),
            F.when(failed, pick(ERROR_MESSAGES, F.col("event_id") % len(ERROR_MESSAGES))).alias("error_message"),
            F.col("ts").alias("started_at"),
            (F.col("ts") + micros * F.expr("INTERVAL '0.000001' SECOND")).alias("completed_at"),
            (F.col("value") * 6).cast("decimal(18,6)").alias("duration_seconds"),
        )

    @cached_property
    def fleet(self) -> DataFrame:
        """Runs of many flows: one flow per user, ``kind`` is the kind of flow it belongs to."""
        return self.runs.withColumns({
            "kind": F.col("pipeline_name"),
            "pipeline_name": F.concat_ws("_", "pipeline_name", F.col("user_id").cast("string")),
        })

    @cached_property
    def stream_metrics(self) -> DataFrame:
        k = F.col("k")
        return self._events_k.select(
            pick(PIPELINES, F.col("user_id") % len(PIPELINES)).alias("pipeline_name"),
            pick(["flink", "spark"], F.col("event_id") % 2).alias("engine"),
            F.col("ts").alias("recorded_at"),
            (k * 2500).alias("consumer_lag"),
            (k * 40).alias("watermark_lag_ms"),
            F.round(F.col("value") * 100).cast("bigint").alias("micro_batch_ms"),
            (F.col("value") * 10).cast("decimal(18,2)").alias("records_per_second"),
        )

    @cached_property
    def taxi(self) -> DataFrame:
        """Raw taxi trips: one per event."""
        micros = F.round(F.col("value") * 60000000).cast("bigint")
        return self._events_k.select(
            F.col("event_id").alias("id"),
            (F.col("event_id") % 3).cast("int").alias("vendor_id"),
            F.col("ts").alias("pickup_datetime"),
            (F.col("ts") + micros * F.expr("INTERVAL '0.000001' SECOND")).alias("dropoff_datetime"),
            F.when(F.col("k") % 12 != 11, (F.col("k") % 12).cast("double")).alias("passenger_count"),
            F.when(F.col("k") % 50 != 49, F.col("k") / F.lit(4.0)).alias("trip_distance"),
            (F.col("event_id") % 265 + 1).cast("int").alias("pu_location_id"),
            (F.col("event_id") * 7 % 265 + 1).cast("int").alias("do_location_id"),
            (F.col("event_id") % 5 + 1).cast("int").alias("payment_type"),
            (F.col("value") * 0.8).alias("fare_amount"),
            (F.col("value") * 0.1).alias("tip_amount"),
            F.col("value").alias("total_amount"),
        )

    @cached_property
    def shop(self) -> DataFrame:
        """Raw commerce orders, one per line item, wide."""
        total = F.col("l_extendedprice").cast("decimal(18,2)")
        lines = spread(self.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"))
        # The buyer is joined to the orders, not to their lines, which would be shuffled once more.
        orders = (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        )
        return (
            lines.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                F.col("o_orderkey").alias("order_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")).alias("category"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                F.col("l_quantity").cast("int").alias("quantity"),
                total.alias("total_amount"),
                F.upper(decode(F.col("o_orderstatus"), ORDER_STATUS)).alias("status"),
                F.col("n_name").alias("city"),
                F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("country"),
                F.col("o_orderdate").alias("created_at"),
            )
        )

    @cached_property
    def shop_orders(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("order_total"),
            decode(F.col("o_orderstatus"), SHOP_STATUS).alias("status"),
            F.col("o_orderpriority").alias("region"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def shop_items(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(38,6)").cast("decimal(18,2)")
            .alias("unit_price"),
        )

    @cached_property
    def shop_products(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("cost"),
        )

    @cached_property
    def incidents(self) -> DataFrame:
        """Incidents with their outcome: one per error event."""
        k = F.col("k")
        closed = k % 20 != 0
        micros = F.round(F.col("value") * 20000000).cast("bigint")
        anomaly = pick(ANOMALY_TYPES, F.col("event_id") % len(ANOMALY_TYPES))
        return self._events_k.filter(F.col("event_type") == "error").select(
            F.col("event_id").alias("incident_id"),
            pick(PIPELINES, F.col("user_id") % len(PIPELINES)).alias("pipeline_name"),
            anomaly.alias("anomaly_type"),
            pick(STRATEGIES, k % len(STRATEGIES)).alias("healing_strategy"),
            pick(OUTCOMES, k % len(OUTCOMES)).alias("outcome"),
            pick(INCIDENT_STATES, k % len(INCIDENT_STATES)).alias("status"),
            F.when(closed, (F.col("value") * 20).cast("decimal(18,6)")).alias("mttr_seconds"),
            (k / F.lit(100.0)).alias("confidence_score"),
            F.col("ts").alias("detection_at"),
            F.when(closed, F.col("ts") + micros * F.expr("INTERVAL '0.000001' SECOND")).alias("resolved_at"),
            F.concat_ws(
                "_", F.lit("fix"), F.lower(anomaly), (k % 50).cast("string"), (F.col("user_id") % 20).cast("string")
            ).alias("fix_id"),
        )

    @cached_property
    def query_log(self) -> DataFrame:
        """One statement per event."""
        cost = F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.round(F.col("value") * 100) * 100)
        return self._events_k.select(
            F.col("event_id").alias("query_id"),
            F.replace(
                pick(STATEMENTS, F.col("event_id") % len(STATEMENTS)), F.lit("{u}"), F.col("user_id").cast("string")
            ).alias("sql"),
            pick(DIALECTS, F.col("user_id") % len(DIALECTS)).alias("dialect"),
            pick(CONTEXTS, F.col("k") % len(CONTEXTS)).alias("context"),
            cost.alias("original_cost"),
            (cost * F.col("k") / 100.0).alias("optimized_cost"),
            F.round(F.col("value") * 40).cast("bigint").alias("execution_ms"),
            F.col("k").alias("rows_returned"),
            (F.col("event_id") % 3 - 1).alias("feedback"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """A data catalog with one column per customer row."""
        n = len(CATALOG_COLUMNS)
        return self.customer.select(
            F.lit("raw").alias("table_schema"),
            F.concat(F.lit("tenant_"), F.floor(F.col("c_custkey") / n).cast("string")).alias("table_name"),
            pick([c[0] for c in CATALOG_COLUMNS], F.col("c_custkey") % n).alias("column_name"),
            pick([c[1] for c in CATALOG_COLUMNS], F.col("c_custkey") % n).alias("data_type"),
            (F.col("c_custkey") % n).cast("int").alias("ordinal"),
        )

    @cached_property
    def catalog_notes(self) -> DataFrame:
        return self.spark.createDataFrame(CATALOG_NOTES, "column_name string, description string, example string")

    @cached_property
    def store_before(self) -> DataFrame:
        """Merge target: every order, keyed."""
        return self.orders.select(
            F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
            F.lit("base").alias("batch"),
        )

    @cached_property
    def store_delta(self) -> DataFrame:
        """Merge input: every order again — urgent ones under a new key, status F with a new total."""
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return self.orders.select(
            F.when(urgent, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("order_key"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("status"),
            (F.col("o_totalprice").cast("decimal(18,2)") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
            .cast("decimal(18,2)").alias("total"),
            F.lit("delta").alias("batch"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Change events per user: signup = INSERT, error = DELETE, else UPDATE; delivered out of order."""
        return self._events_k.select(
            F.col("event_id").alias("offset"),
            F.col("user_id").alias("key"),
            F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE")
            .otherwise("UPDATE").alias("op"),
            F.col("ts").alias("event_time"),
            F.col("props").alias("payload"),
        )

    @cached_property
    def damaged(self) -> DataFrame:
        """Orders with injected nulls, padding and repeats, the input of the remediation functions."""
        base = self.orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("customer_id"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("amount"),
            F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("category"),
            F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("event_time"),
        )
        again = base.filter(F.col("category").isNull())
        return base.unionByName(again)

    @cached_property
    def lineage_edges(self) -> DataFrame:
        """Dependency edges: region -> nation -> customer / supplier -> order."""
        def node(prefix: str, c: str) -> Column:
            return F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))

        per_supplier = self.lineitem.select("l_suppkey", "l_orderkey").distinct()
        pairs = [
            (self.nation, node("region", "n_regionkey"), node("nation", "n_nationkey")),
            (self.customer, node("nation", "c_nationkey"), node("customer", "c_custkey")),
            (self.supplier, node("nation", "s_nationkey"), node("supplier", "s_suppkey")),
            (self.orders, node("customer", "o_custkey"), node("order", "o_orderkey")),
            (per_supplier, node("supplier", "l_suppkey"), node("order", "l_orderkey")),
        ]
        out = None
        for df, src, dst in pairs:
            part = df.select(src.alias("src"), dst.alias("dst"))
            out = part if out is None else out.unionByName(part)
        return out
