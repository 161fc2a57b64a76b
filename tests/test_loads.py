"""Load modes, versioned tables, watermarks, landing, models."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.operators import merge as mg
from tidemill.operators import transforms as tr
from tidemill.plans import marts, staging
from tidemill.session import checkpoint_root
from tidemill.sources import json_pages, readers, sinks


def table(spark, data):
    return spark.createDataFrame(data, "k int, v string, batch string")


@pytest.mark.parametrize("whole", [False, True])
def test_merge_statistics(spark, rows, whole):
    target = table(spark, [(1, "a", "t"), (2, "b", "t"), (9, "z", "t")])
    delta = table(spark, [(1, "a", "d"), (2, "B", "d"), (3, "c", "d")])
    merged = mg.merge(target, delta, ["k"], [F.desc("batch")], skip=["batch"], whole=whole)
    assert rows(merged) == [(1, "a", "t", "unchanged"), (2, "B", "d", "update"), (3, "c", "d", "insert"), (9, "z", "t", "kept")]
    assert tuple(mg.merge_stats(merged).first()) == (3, 1, 1, 1, 2)
    again = mg.merge(merged.drop("_action"), delta, ["k"], [F.desc("batch")], skip=["batch"], whole=whole)
    assert rows(again, "k", "v", "batch") == rows(merged, "k", "v", "batch")
    assert again.filter("_action IN ('insert', 'update')").count() == 0


def test_merge_takes_one_row_per_key(spark, rows):
    delta = table(spark, [(1, "old", "d"), (1, "new", "e")])
    merged = mg.merge(table(spark, [(1, "x", "t")]), delta, ["k"], [F.desc("batch")], skip=["batch"])
    assert rows(merged) == [(1, "new", "e", "update")]


def test_upsert_keeps_the_count(spark):
    target = spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit("t").alias("batch"))
    delta = target.filter("k < 10").withColumn("v", F.lit("b"))
    once = mg.upsert(target, delta, ["k"])
    assert once.count() == 2000 and once.filter("v = 'b'").count() == 10
    assert mg.upsert(once, delta, ["k"]).exceptAll(once).count() == 0


def test_insert_ignore_keeps_the_first(spark, rows):
    delta = table(spark, [(1, "b", "d"), (2, "q", "d"), (2, "p", "d")])
    got = mg.insert_ignore(table(spark, [(1, "a", "t")]), delta, ["k"], mg.full_order(delta))
    assert rows(got) == [(1, "a", "t"), (2, "p", "d")]


def test_statistics_count_a_repeated_key_once(spark):
    delta = spark.createDataFrame([(1, "z-old", 1), (1, "a-first", 2), (1, "same", 3), (2, "new", 4), (2, "newer", 5)], "k int, v string, seq int")
    target = spark.createDataFrame([(1, "same", 0), (3, "other", 0)], "k int, v string, seq int")
    merged = mg.merge(target, delta, ["k"], [F.desc("seq")], skip=["seq"])
    assert {r.k: (r.v, r._action) for r in merged.collect()} == {1: ("same", "unchanged"), 2: ("newer", "insert"), 3: ("other", "kept")}
    assert tuple(mg.merge_stats(merged).first()) == (2, 1, 0, 1, 1)


def test_replace_takes_the_last_row_of_a_key(spark, rows):
    delta = table(spark, [(1, "z", "1"), (1, "a", "2"), (1, "m", "3")])
    assert rows(mg.insert_or_replace(table(spark, [(1, "x", "0")]), delta, ["k"], [F.desc("batch")])) == [(1, "m", "3")]


def test_upsert_without_a_key_replaces_by_the_primary_key(spark, rows):
    delta = table(spark, [(1, "z", "1"), (1, "a", "2")])
    target = table(spark, [(1, "x", "0"), (2, "y", "0")])
    for keys in ([], ["absent"]):
        assert rows(mg.upsert(target, delta, keys, ["k"], [F.desc("batch")])) == [(1, "a", "2"), (2, "y", "0")]
    with pytest.raises(ValueError):
        mg.upsert(target, delta, [])


def test_small_and_large_changes_of_a_double_are_updates(spark):
    values = [0.0, 1.0, 1e33, float("nan"), None]
    target = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    delta = spark.createDataFrame(list(enumerate([1e-8, 1.0, 1.0000001e33, float("nan"), float("nan")])), "k int, v double")
    merged = mg.merge(target, delta, ["k"], [F.col("v")])
    assert {r.k: r._action for r in merged.collect()} == {0: "update", 1: "unchanged", 2: "update", 3: "unchanged", 4: "update"}
    keys = target.select(mg.surrogate_key(target, ["v"]).alias("h"))
    assert keys.distinct().count() == 5


def test_the_hash_on_the_target_is_used_and_kept(spark):
    delta = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    target = delta.withColumn("_ROW_HASH", mg.row_hash(delta))
    target = target.withColumn("_ROW_HASH", F.when(F.col("k") == 1, F.lit("stale")).otherwise(F.col("_ROW_HASH")))
    merged = mg.merge(target, delta, ["k"], [F.col("v")])
    assert {r.k: r._action for r in merged.collect()} == {1: "update", 2: "unchanged"}
    assert merged.select("k", "v", "_ROW_HASH").exceptAll(delta.withColumn("_ROW_HASH", mg.row_hash(delta))).isEmpty()


def test_surrogate_key_joins_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (1, "")], "a int, b string")
    assert df.select(mg.surrogate_key(df).alias("h")).distinct().count() == 1


def test_small_batch_leaves_the_target_unshuffled(spark, tables, tmp_path):
    path = str(tmp_path / "target")
    tables.orders.write.parquet(path)
    target = spark.read.parquet(path)
    plan = mg.upsert(target, tables.orders.limit(5), ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_bucketed_tables_join_without_a_shuffle(spark, tables, tmp_path):
    a = sinks.write_bucketed(tables.orders, "t_orders_bucketed", str(tmp_path / "a"), ["o_orderkey"], 4)
    lines = tables.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    b = sinks.write_bucketed(lines, "t_lines_bucketed", str(tmp_path / "b"), ["o_orderkey"], 4)
    joined = a.hint("merge").join(b, "o_orderkey").groupBy("o_orderkey").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == lines.select("o_orderkey").distinct().count()
    for name in ("t_orders_bucketed", "t_lines_bucketed"):
        spark.sql(f"DROP TABLE {name}")


def test_days_outside_the_range_are_not_read(spark, tables, tmp_path):
    path = str(tmp_path / "days")
    sinks.write_by_day(tables.runs, path, "started_at")
    week = sinks.read_days(spark, path, "2024-01-03", "2024-01-04")
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert week.count() == tables.runs.filter("to_date(started_at) BETWEEN '2024-01-03' AND '2024-01-04'").count()


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), create=True)
    assert t.version() == 0
    t.replace(table(spark, [(1, "a", "t")]))
    t.append(table(spark, [(2, "b", "t")]))
    assert t.read().count() == 2
    # The new version may be computed from the old one.
    t.replace(t.read().withColumn("v", F.lit("c")))
    assert t.version() == 2 and t.read().filter("v = 'c'").count() == 2


def test_watermark_round_trip(spark, tmp_path):
    store = sinks.WatermarkStore(spark, str(tmp_path / "w"), create=True)
    now = dt.datetime(2024, 6, 1)
    assert store.get("f", "t") is None
    for day in (1, 2):
        store.set("f", "t", "at", dt.datetime(2024, 1, day), now)
    store.set("g", "t", "at", dt.datetime(2024, 5, 5), now)
    assert store.get("f", "t") == dt.datetime(2024, 1, 2) and store.all().count() == 2
    assert store.marks("timestamp_ntz").agg(F.max("value")).first()[0] == dt.datetime(2024, 5, 5)


@pytest.mark.parametrize("value", [42, 10**15, "z9", 2.5, dt.date(2024, 2, 3), Decimal("12.500000000000000000")])
def test_watermark_of_any_type(spark, tmp_path, value):
    store = sinks.WatermarkStore(spark, str(tmp_path / "w"), create=True)
    store.set("f", "t", "c", value, dt.datetime(2024, 6, 1))
    assert store.get("f", "t") == value and type(store.get("f", "t")) is type(value)
    assert store.all().first().updated_at == dt.datetime(2024, 6, 1)


def test_strictly_after_the_mark(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 2, 3)], "at timestamp_ntz")
    assert readers.since(df, "at", dt.datetime(2024, 1, 2)).count() == 1
    assert readers.since(df, "at", None).count() == 3


def test_loaded_types(spark):
    df = spark.createDataFrame([], "a int, b double, c boolean, d timestamp, e string, f array<int>")
    assert list(sinks.loaded_types(df).values()) == [
        "BIGINT", "DOUBLE PRECISION", "BOOLEAN", "TIMESTAMPTZ", "TEXT", "TEXT", "TEXT", "TIMESTAMPTZ", "TEXT"]


def test_formats():
    assert readers.detect_format("a/b.parquet?x=1") == "parquet"
    assert readers.detect_format("a/b.csv", "JSON") == "json"
    assert readers.detect_format("a/b") == "csv"
    assert readers.object_path("bucket", "/k/a.csv") == "s3a://bucket/k/a.csv"


def test_casts(spark, rows):
    df = spark.createDataFrame([("3.9",), ("-3.9",), ("x",), (None,), ("1e3",)], "c string")
    got = tr.apply_transforms(df, [tr.Cast("c", "integer")])
    assert rows(got) == rows(spark.createDataFrame([(3, False), (-3, False), (None, True), (None, False), (1000, False)], "c bigint, f boolean"))


def test_write_statements_are_refused(spark):
    with pytest.raises(ValueError):
        readers.select_sql(spark, {}, "delete from t")


def test_zipped_json(spark, rows):
    df = spark.createDataFrame([(1, '{"a":[1,2],"b":["x","y"]}'), (2, '{"a":[1],"b":["x","y"]}'), (3, "[5]"), (4, "7"), (5, "[]"), (6, None)], "id int, p string")
    got = rows(json_pages.json_rows(df, "p", None, ["id"], ["a", "b", "value"]))
    assert got == [(1, "1", "x", None), (1, "2", "y", None), (2, "[1]", '["x","y"]', None), (3, None, None, "5")]


def test_missing_checkpoint_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    Session.conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_cohort_months_wrap(spark):
    orders = spark.createDataFrame([
        (1, 7, "completed", 10.0, dt.datetime(2023, 1, 5)), (2, 7, "shipped", 20.0, dt.datetime(2024, 2, 9))],
        "id int, customer_id int, status string, order_total double, created_at timestamp_ntz")
    row = marts.fct_customer_cohort(orders).orderBy("activity_month").collect()[-1]
    assert (row.months_since_acquisition, row.months_total, row.cohort_size, row.retention_pct) == (1, 13, 1, 100.0)


def test_trip_cleaning(spark):
    t0 = dt.datetime(2024, 1, 7, 10)
    base = dict(vendor_id=1, pickup_datetime=t0, trip_distance=1.0, pu_location_id=1, do_location_id=2, payment_type=1,
                fare_amount=2.345, tip_amount=0.0, total_amount=3.0)
    seconds = {1: 59, 2: 60, 3: 7200, 4: 7201, 5: 600}
    data = [dict(base, id=i, dropoff_datetime=t0 + dt.timedelta(seconds=s), passenger_count=c)
            for (i, s), c in zip(seconds.items(), [1.0, math.nan, 9.0, 1.0, 10.0])]
    got = {r.trip_id: r for r in staging.stg_trips(spark.createDataFrame(data)).collect()}
    assert set(got) == {2, 3, 5}
    assert [got[i].passenger_count for i in (2, 3, 5)] == [1, 9, 1]
    assert got[2].pickup_day_of_week == 0 and got[2].is_airport_trip and float(got[2].fare_amount) == 2.35


def test_zoned_merge_leaves_untouched_zones_alone(spark, tmp_path, rows):
    def files():
        return {str(p.relative_to(tmp_path)) for p in (tmp_path / "t").rglob("*.parquet")}

    def batch(*some):
        return spark.createDataFrame(some, "id long, name string, at int")

    path, zone = str(tmp_path / "t"), F.floor(F.col("id") / 100)
    sinks.create_zoned(spark.range(500).selectExpr("id", "concat('n', id) AS name", "1 AS at"), path, zone)
    first = files()
    done = sinks.merge_zoned(spark, path, batch((3, "new", 2), (4, "n4", 2), (5, "old", 1), (5, "newer", 2), (210, "n210", 2), (450, "n450", 1), (777, "in", 2), (499, "n499", 9)),
                             ["id"], [F.desc("at")], zone, ("at",))
    assert rows(done) == [(0, "unchanged", 1), (0, "update", 2), (2, "unchanged", 1), (4, "unchanged", 2), (7, "insert", 1)]
    second = files()
    kept = {f for f in first if "zone=0" not in f}
    assert kept <= second and not {f for f in first if "zone=0" in f} & second
    assert len({f for f in second if "zone=7" in f}) >= 1 and second - first == {f for f in second if "zone=0" in f or "zone=7" in f}
    table = spark.read.parquet(path)
    assert table.count() == 501 and rows(table.filter("id IN (3, 4, 5, 777)").select("id", "name", "at")) == [
        (3, "new", 2), (4, "n4", 1), (5, "newer", 2), (777, "in", 2)]
    # Only new keys: a file is added, none is replaced; again the same batch: nothing happens.
    for expected in ("insert", "unchanged"):
        before = files()
        got = sinks.merge_zoned(spark, path, batch((888, "x", 3), (150, "n150", 3)), ["id"], [F.desc("at")], zone, ("at",))
        assert {r._action for r in got.filter("zone = 8").collect()} == {expected} and before <= files()
    assert files() == before and spark.read.parquet(path).count() == 502


def test_a_mark_of_an_unknown_type_is_refused(spark, tmp_path):
    import pytest

    marks = sinks.WatermarkStore(spark, str(tmp_path / "marks"), create=True)
    with pytest.raises(TypeError, match="complex"):
        marks.set("f", "t", "c", 1j, dt.datetime(2024, 1, 1))


def test_a_zone_gets_its_rows_in_one_file_from_a_batch(spark, tmp_path):
    path, zone = str(tmp_path / "t"), F.floor(F.col("id") / 100)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a batch in several tasks, as a large one is
    try:
        sinks.create_zoned(spark.range(1000).selectExpr("id", "concat('n', id) AS name", "1 AS at"), path, zone)
        batch = spark.range(500, 2000).selectExpr("id", "concat('m', id) AS name", "2 AS at")
        sinks.merge_zoned(spark, path, batch, ["id"], [F.desc("at")], zone, ("at",))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "t").glob("zone=*")}
    assert len(files) == 20 and set(files.values()) == {1}
    table = spark.read.parquet(path)
    assert table.count() == 2000 and table.filter("name = concat('m', id)").count() == 1500


def test_buckets_follow_the_rows_of_the_larger_table(spark):
    assert sinks.bucket_count(spark.range(995), spark.range(5), least=2, rows=100) == 10
    assert sinks.bucket_count(spark.range(5), spark.range(995), rows=100) == 10
    assert sinks.bucket_count(spark.range(0), spark.range(5)) == 8
