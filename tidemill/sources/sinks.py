"""Writers: append, versioned full refresh, counted load, watermark state, run rows."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.merge import pick_one, row_hash
from tidemill.session import cut_lineage


class VersionedTable:
    """A table on plain Parquet that is replaced as a whole.

    Each write makes a new folder and then appends its number to a small log; readers use the
    newest logged version, so a path is never overwritten while it is read and a failed write
    leaves no trace in the log. ``create=True`` starts an empty table (version 0).
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        if create:
            self._log(0)

    def _log(self, version: int) -> None:
        row = self.spark.range(1).select(F.lit(version).alias("version"))
        row.write.mode("append").json(f"{self.path}/versions")

    def version(self) -> int:
        return self.spark.read.schema("version int").json(f"{self.path}/versions").agg(F.max("version")).first()[0]

    def replace(self, df: DataFrame, version: int | None = None) -> DataFrame:
        new = self.version() + 1 if version is None else version
        df.write.parquet(f"{self.path}/v{new}")
        self._log(new)
        return self.read()

    def append(self, df: DataFrame) -> DataFrame:
        if self.version() == 0:
            return self.replace(df)
        df.write.mode("append").parquet(f"{self.path}/v{self.version()}")
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")


def write_by_day(df: DataFrame, path: str, time: str, mode: str = "append") -> None:
    """Append to a table partitioned by day, so that readers bounded in time only list those days.

    The rebalance hint gathers a day's rows into files of a good size and lets the adaptive planner
    split a day that holds most of them.
    """
    dated = df.withColumn("day", F.to_date(time))
    dated.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows of the days first..last; other folders are not read."""
    return spark.read.parquet(path).filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def create_zoned(df: DataFrame, path: str, zone: Column) -> None:
    """Write a table whose rows lie in folders by ``zone``, an expression over its key columns (a range of ids, a day)."""
    _by_zone(df.withColumn("zone", zone)).parquet(path)


def _by_zone(df: DataFrame):
    """Writer of a zoned table. A zone's rows meet in one task, or in a few if it is large; else every task would add a file to
    every zone, and the number of files would grow with tasks times zones."""
    return df.hint("rebalance", "zone").write.partitionBy("zone")


def merge_zoned(spark: SparkSession, path: str, delta: DataFrame, keys: list[str], order: list[Column], zone: Column,
                skip: tuple[str, ...] = ()) -> DataFrame:
    """Content-hash merge of a batch into a table of ``create_zoned``; returns (zone, _action, rows) of the batch.

    Only the zones of the batch's keys are read. New keys are appended as files of their own; a zone is written anew only
    if a row of it changes, all other folders keep their files. Inserts come first and a rewrite replaces whole zones, so
    a batch that is run again after a failure leaves the same table.
    """
    batch = cut_lineage(pick_one(delta, keys, order).withColumn("zone", zone), "batch")
    zones = [r.zone for r in batch.select("zone").distinct().collect()]  # one value per folder that the batch touches
    table = spark.read.parquet(path)
    columns = [c for c in table.columns if c != "zone"]

    def of(df: DataFrame, some: list) -> DataFrame:
        return df.filter(F.col("zone").isin(some) | (F.col("zone").isNull() if None in some else F.lit(False)))

    held = of(table, zones)
    same = row_hash(held.select(*columns), list(skip)) if "_ROW_HASH" not in columns else F.col("_ROW_HASH")
    known = held.select(*keys, F.col("zone").alias("_zone"), same.alias("_held"))
    met = batch.withColumn("_new", row_hash(batch.select(*[c for c in columns if c in batch.columns]), list(skip))).join(known, keys, "left").withColumn(
        "_action", F.when(F.col("_held").isNull(), "insert").when(F.col("_held") != F.col("_new"), "update").otherwise("unchanged"))
    met = cut_lineage(met.drop("_zone", "_held"), "met")
    if "_ROW_HASH" in columns:
        met = met.withColumn("_ROW_HASH", F.col("_new"))
    inserts = met.filter("_action = 'insert'").select(*columns, "zone")
    _by_zone(inserts).mode("append").parquet(path)
    updates = met.filter("_action = 'update'")
    changed = [r.zone for r in updates.select("zone").distinct().collect()]
    if changed:
        now = of(spark.read.parquet(path), changed)
        kept = now.join(updates.select(*keys), keys, "left_anti").select(*columns, "zone")
        whole = cut_lineage(kept.unionByName(updates.select(*columns, "zone")), "zones")
        _by_zone(whole).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return met.groupBy("zone", "_action").agg(F.count("*").alias("rows"))


def bucket_count(*dfs: DataFrame, least: int = 8, rows: int = 1_000_000) -> int:
    """Buckets for tables that are joined: a task sorts and joins a whole bucket, so their number grows with the largest table."""
    return max(least, *(math.ceil(df.count() / rows) for df in dfs))


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write a catalog table hashed and sorted by its join keys.

    Tables bucketed alike by their keys join and aggregate on them without a shuffle, which pays off
    for the large tables that every model joins again.
    """
    # One task per bucket writes one file per bucket.
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def load_counted(df: DataFrame, path: str, ok: Column) -> dict:
    """Write the rows that pass ``ok`` and return loaded and failed counts, observed in the same job."""
    seen = Observation("load")
    df.observe(
        seen, F.count_if(ok).alias("loaded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed")
    ).filter(ok).write.mode("append").parquet(path)
    return seen.get


# Spark type of a mark by the Python type of its value.
MARK_TYPES = {bool: "boolean", int: "bigint", float: "double", Decimal: "decimal(38,18)", dt.datetime: "timestamp_ntz",
              dt.date: "date", str: "string"}


class WatermarkStore:
    """High-water marks per (flow, table), kept as a versioned table: text of the value, its type and when it was set."""

    SCHEMA = "flow string, table_name string, column_name string, value string, value_type string, updated_at timestamp_ntz"

    def __init__(self, spark: SparkSession, path: str, create: bool = False):
        self.spark, self.table = spark, VersionedTable(spark, path, create)

    def all(self) -> DataFrame:
        return self.table.read() if self.table.version() else self.spark.createDataFrame([], self.SCHEMA)

    def marks(self, value_type: str) -> DataFrame:
        """(flow, table_name, value) of the marks of one type, as that type."""
        return self.all().filter(F.col("value_type") == value_type).select(
            "flow", "table_name", F.col("value").cast(value_type).alias("value"))

    def get(self, flow: str, table_name: str):
        one = self.all().filter((F.col("flow") == flow) & (F.col("table_name") == table_name)).select("value", "value_type").first()
        if one is None:
            return None
        return self.spark.range(1).select(F.lit(one.value).cast(one.value_type)).first()[0]

    def set(self, flow: str, table_name: str, column: str, value, updated_at: dt.datetime) -> None:
        kind = next((v for k, v in MARK_TYPES.items() if type(value) is k), None)
        if kind is None:
            raise TypeError(f"a mark cannot hold a {type(value).__name__}")
        new = self.spark.createDataFrame([(flow, table_name, column, value, updated_at)],
                                         f"flow string, table_name string, column_name string, value {kind}, updated_at timestamp_ntz")
        new = new.select("flow", "table_name", "column_name", F.col("value").cast("string").alias("value"),
                         F.lit(kind).alias("value_type"), "updated_at")
        rest = self.all().join(new.select("flow", "table_name"), ["flow", "table_name"], "left_anti")
        self.table.replace(rest.unionByName(new).coalesce(1))


def advance_marks(rows: DataFrame, marks: DataFrame, keys: list[str], cursor: str) -> DataFrame:
    """For each key: rows strictly after its mark, the new mark and the load mode.

    ``marks`` holds one row per key (keys, value). A key without a mark loads everything.
    """
    old = marks.select(*keys, F.col("value").alias("old_mark"))
    fresh = rows.join(old, keys, "left").filter(F.col("old_mark").isNull() | (F.col(cursor) > F.col("old_mark")))
    return fresh.groupBy(*keys, "old_mark").agg(
        F.count(F.lit(1)).alias("rows"), F.max(cursor).alias("new_mark")
    ).withColumn("load_mode", F.when(F.col("old_mark").isNull(), "initial").otherwise("incremental"))


# Column type in the loaded table per kind of source type; anything else is text.
LOADED_TYPES = {
    "tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "BIGINT",
    "float": "DOUBLE PRECISION", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN",
    "date": "TIMESTAMPTZ", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMPTZ",
}
META_TYPES = {"_SOURCE": "TEXT", "_INGESTED_AT": "TIMESTAMPTZ", "_RUN_ID": "TEXT"}


def loaded_types(df: DataFrame) -> dict[str, str]:
    """Types of the table a load creates, its metadata columns included."""
    return {f.name: LOADED_TYPES.get(f.dataType.simpleString(), "TEXT") for f in df.schema.fields} | META_TYPES


def run_row(df_read: DataFrame, df_loaded: DataFrame, flow: str, started_at: Column, completed_at: Column) -> DataFrame:
    """A run record for a load: ingested, loaded, failed = read - written, status, duration."""
    read = df_read.agg(F.count(F.lit(1))).scalar()
    loaded = df_loaded.agg(F.count(F.lit(1))).scalar()
    return df_read.sparkSession.range(1).select(
        F.lit(flow).alias("pipeline_name"), read.alias("records_ingested"), loaded.alias("records_loaded"),
        (read - loaded).alias("records_failed"),
        F.when(loaded == read, "success").when(loaded > 0, "warning").otherwise("failed").alias("status"),
        started_at.alias("started_at"), completed_at.alias("completed_at"),
        F.timestamp_diff("SECOND", started_at, completed_at).alias("duration_seconds"),
    )


def recent_loads(runs: DataFrame, flow: str, n: int, tie: str = "run_no") -> DataFrame:
    """The newest n runs of one flow."""
    return runs.filter(F.col("pipeline_name") == flow).orderBy(F.desc("started_at"), F.desc(tie)).limit(n)
