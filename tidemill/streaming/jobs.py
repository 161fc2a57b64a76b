"""Streaming jobs: incremental load, change application, deduplication, run monitoring, late rows, roll-ups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions import constants as k
from tidemill.functions.exprs import dbl, decode, rnd, safe_divide
from tidemill.operators.anomalies import classify_error
from tidemill.operators.merge import pick_one


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, **options: str) -> DataFrame:
    """JSON messages of a topic as typed rows with their partition and offset; needs the Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v"), "partition", "offset").select("v.*", "partition", "offset")


def available(df: DataFrame, checkpoint: str):
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def start_incremental(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append everything not yet loaded, then stop; the checkpoint is the high-water mark."""
    return available(source, checkpoint).format("parquet").outputMode("append").start(target)


def latest_changes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest change per key."""
    return pick_one(changes, keys, [F.desc(c) for c in order])


def apply_changes(changes: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """Table content after the changes: newest per key wins, deleted keys are absent."""
    return latest_changes(changes, keys, order).filter(F.col(op) != "DELETE")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB with a changelog; those of a first start stay with its checkpoint."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start_change_application(source: DataFrame, keys: list[str], order: list[str], checkpoint: str, feed: str | None = None) -> StreamingQuery:
    """Keep the newest change per key in Spark's keyed state, deletes included, so late older changes cannot win.

    A batch costs its own keys: the state is a RocksDB store with a changelog, whatever its size. ``changed_table`` reads
    it as a table. With ``feed``, the keys that each batch touched are also written there, in a folder named by the batch,
    which a replay overwrites.
    """
    rest = [c for c in source.columns if c not in keys]
    newest = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")).select(*keys, "newest.*")

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")

    writer = available(newest, checkpoint).outputMode("update")
    with state_store(source.sparkSession):
        return (writer.foreachBatch(publish) if feed else writer.format("noop")).start()


def changed_table(spark: SparkSession, checkpoint: str, op: str = "op", deleted: bool = False) -> DataFrame:
    """The table that the changes applied under ``checkpoint`` leave; with ``deleted``, their tombstones too."""
    state = spark.read.format("statestore").load(checkpoint)
    rows = state.select("key.*", "value.valueWithExtremumOrdering.*")
    return rows if deleted else rows.filter(F.col(op) != "DELETE")


def start_deduplication(source: DataFrame, keys: list[str], time: str, lateness: str, target: str, checkpoint: str) -> StreamingQuery:
    """Drop repeats of a key that arrive within the lateness bound; state older than it is freed."""
    unique = source.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
    return available(unique, checkpoint).format("parquet").outputMode("append").start(target)


def run_findings(runs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Rules that need only the run itself (and a baseline mean load per flow, when given)."""
    kind, loaded = F.col("pipeline_name"), F.coalesce("records_loaded", F.lit(0))
    seconds, ok = dbl(F.col("duration_seconds")), F.col("status") == "success"
    error = F.when((F.col("status") == "failed") & (F.length("error_message") > 0), classify_error(F.col("error_message")))
    if baseline is None:
        runs = runs.withColumn("avg_loaded", F.lit(None).cast("double"))
    else:
        runs = runs.join(baseline, "pipeline_name", "left")
    average = F.col("avg_loaded")
    drop = safe_divide(average - loaded, average)
    rules = [
        ("zero_load", ok & (loaded == 0), F.lit("ZERO_LOAD")),
        ("row_count_drop", (average > 0) & (drop > k.ROW_DROP_SHARE), F.lit("ROW_COUNT_DROP")),
        ("sla_breach", seconds > decode(kind, k.SLA_SECONDS, k.DEFAULT_SLA_SECONDS) * k.SLA_FACTOR, F.lit("SLA_BREACH")),
        ("checkpoint_health", (kind == "flink_job") & (error.isNotNull() | (seconds > k.CHECKPOINT_SECONDS)),
         F.coalesce(error, F.lit("CHECKPOINT_FAILURE"))),
        ("micro_batch_health", (kind == "spark_streaming") & (error.isNotNull() | (seconds > k.MICRO_BATCH_SECONDS) | (ok & (loaded == 0))),
         F.coalesce(error, F.when(seconds > k.MICRO_BATCH_SECONDS, "PIPELINE_DELAY").otherwise("ZERO_LOAD"))),
    ]
    found = F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("rule"), kind_.alias("anomaly_type"))) for name, cond, kind_ in rules])
    fired = runs.select("run_no", "pipeline_name", "started_at", F.explode(found).alias("f")).filter(F.col("f").isNotNull())
    return fired.select("run_no", "pipeline_name", "started_at", "f.*")


def start_run_monitor(source: DataFrame, target: str, checkpoint: str, baseline: DataFrame | None = None) -> StreamingQuery:
    """Write the findings of each batch of runs; a batch id folder makes a replay overwrite itself."""
    def check(batch: DataFrame, batch_id: int) -> None:
        run_findings(batch, baseline).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return available(source, checkpoint).foreachBatch(check).start()


def split_late(batch: DataFrame, time: str, newest: Column, lateness: str) -> DataFrame:
    """Flag rows older than the newest time seen before minus the lateness bound."""
    n, unit = lateness.split()
    limit = newest - F.expr(f"INTERVAL '{n}' {unit.rstrip('s').upper()}")
    return batch.withColumn("is_late", F.coalesce(F.col(time) < limit, F.lit(False)))


def start_late_split(source: DataFrame, time: str, lateness: str, target: str, checkpoint: str) -> StreamingQuery:
    """Write on-time and late rows apart (partition is_late); lateness is judged against earlier batches.

    Each batch leaves the newest time so far in a one-row table of its own under ``target``_newest, which the next one
    reads; a replayed batch writes over its own.
    """
    spark = source.sparkSession

    def split(batch: DataFrame, batch_id: int) -> None:
        before = F.lit(None).cast("timestamp_ntz")
        if batch_id:
            before = spark.read.schema("newest timestamp_ntz").parquet(f"{target}_newest/{batch_id - 1}").scalar()
        split_late(batch, time, before, lateness).write.mode("overwrite").partitionBy("is_late").parquet(f"{target}/batch={batch_id}")
        newest = batch.agg(F.max(F.col(time).cast("timestamp_ntz")).alias("own")).select(F.greatest("own", before).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{target}_newest/{batch_id}")

    return available(source, checkpoint).foreachBatch(split).start()


def _near_buckets(first: DataFrame, second: DataFrame, keys: list[str], time: str, seconds: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with the number of their time span; the first side also stands in the next one, so partners meet.

    The span is part of the join key, so the rows of one key spread over its spans.
    """
    def span(c: Column) -> Column:
        return F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000))

    a = first.select(*[F.col(c).alias(f"first_{c}") for c in first.columns]).withColumn(
        "_span", F.explode(F.array(span(F.col(f"first_{time}")), span(F.col(f"first_{time}")) + 1)))
    b = second.select(*[F.col(c).alias(f"second_{c}") for c in second.columns]).withColumn("_other", span(F.col(f"second_{time}")))
    gap = F.make_dt_interval(secs=F.lit(seconds))
    match = (F.col("_span") == F.col("_other")) & (F.col(f"second_{time}") > F.col(f"first_{time}")) \
        & (F.col(f"second_{time}") <= F.col(f"first_{time}") + gap)
    for key in keys:
        match = match & (F.col(f"first_{key}") == F.col(f"second_{key}"))
    return a, b, match


def followed_within(first: DataFrame, second: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Pairs of a row of ``first`` and a later row of ``second`` of the same keys, at most ``seconds`` apart.

    Columns get the prefixes first_ and second_. Null keys and times pair with nothing.
    """
    a, b, match = _near_buckets(first, second, keys, time, seconds)
    return a.join(b, match).drop("_span", "_other")


def start_followed_within(first: DataFrame, second: DataFrame, keys: list[str], time: str, seconds: int, lateness: str,
                          target: str, checkpoint: str) -> StreamingQuery:
    """``followed_within`` over two streams; state of a row is freed once the watermark says that no partner can come."""
    a, b, match = _near_buckets(first.withWatermark(time, lateness), second.withWatermark(time, lateness), keys, time, seconds)
    pairs = a.join(b, match).drop("_span", "_other")
    return available(pairs, checkpoint).format("parquet").outputMode("append").start(target)


def rollup(metrics: DataFrame, unit: str, time: str = "recorded_at") -> DataFrame:
    """Tumbling-window measures per flow and engine; works on a table or, with a watermark, on a stream."""
    return metrics.groupBy("pipeline_name", "engine", F.window(time, unit).alias("w")).agg(
        F.count("*").alias("samples"), F.max("consumer_lag").alias("max_lag"), F.max("watermark_lag_ms").alias("max_watermark_lag_ms"),
        rnd(safe_divide(F.sum("micro_batch_ms"), F.count("micro_batch_ms")), 2).alias("avg_batch_ms"),
        rnd(safe_divide(F.sum("records_per_second"), F.count("records_per_second")), 2).alias("avg_records_per_second"),
    ).select("pipeline_name", "engine", F.col("w.start").alias("window_start"), "samples", "max_lag", "max_watermark_lag_ms",
             "avg_batch_ms", "avg_records_per_second")


def start_rollup(source: DataFrame, unit: str, lateness: str, target: str, checkpoint: str, time: str = "recorded_at") -> StreamingQuery:
    """Closed windows only: a window is written once the watermark has passed it."""
    return available(rollup(source.withWatermark(time, lateness), unit, time), checkpoint).format("parquet").outputMode("append").start(target)
