"""Streaming jobs end in the batch result, also when restarted."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemill.streaming import jobs

CHANGES = "key int, op string, event_time timestamp_ntz, offset bigint, payload string"


def change(op, minute, offset, payload="p", key=1):
    return (key, op, dt.datetime(2024, 1, 1, 0, minute), offset, payload)


def feed(spark, path, rows):
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(path)


def apply(spark, tmp, feed_to=None):
    source = jobs.file_stream(spark, str(tmp / "in"), spark.createDataFrame([], CHANGES).schema)
    query = jobs.start_change_application(source, ["key"], ["event_time", "offset"], str(tmp / "mark"), feed_to)
    query.awaitTermination()
    return query


def live(spark, tmp):
    return sorted((r.key, r.payload) for r in jobs.changed_table(spark, str(tmp / "mark")).collect())


def test_out_of_order_changes_and_delete(spark):
    events = [change("INSERT", 1, 1, "t1"), change("UPDATE", 3, 3, "t3"), change("UPDATE", 2, 2, "t2")]
    df = spark.createDataFrame(events, CHANGES)
    assert [r.payload for r in jobs.apply_changes(df, ["key"], ["event_time", "offset"]).collect()] == ["t3"]
    deleted = spark.createDataFrame([*events, change("DELETE", 4, 4)], CHANGES)
    assert jobs.apply_changes(deleted, ["key"], ["event_time", "offset"]).count() == 0


def test_changes_survive_restart_and_late_rows(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [change("INSERT", 1, 1, "a"), change("DELETE", 9, 9, key=2)])
    apply(spark, tmp_path)
    assert live(spark, tmp_path) == [(1, "a")]
    # A new query over the same checkpoint; the late insert of key 2 is older than its delete.
    feed(spark, str(tmp_path / "in"), [change("UPDATE", 5, 5, "b"), change("INSERT", 2, 2, "late", key=2), change("INSERT", 6, 6, "c", key=3)])
    apply(spark, tmp_path)
    assert live(spark, tmp_path) == [(1, "b"), (3, "c")]
    feed(spark, str(tmp_path / "in"), [change("UPDATE", 4, 4, "older"), change("DELETE", 7, 7, key=3), change("INSERT", 10, 10, "back", key=2)])
    apply(spark, tmp_path)
    assert live(spark, tmp_path) == [(1, "b"), (2, "back")]
    everything = jobs.changed_table(spark, str(tmp_path / "mark"), deleted=True)
    assert sorted(r.key for r in everything.collect()) == [1, 2, 3]


def test_any_order_of_batches_gives_the_batch_result(spark, tmp_path, rows):
    rnd = random.Random(4)
    changes = [change(rnd.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), rnd.randrange(60), i, f"p{i}", rnd.randrange(12)) for i in range(120)]
    rnd.shuffle(changes)
    for a in range(0, 120, 30):
        feed(spark, str(tmp_path / "in"), changes[a:a + 30])
        apply(spark, tmp_path)
    want = jobs.apply_changes(spark.createDataFrame(changes, CHANGES), ["key"], ["event_time", "offset"])
    got = jobs.changed_table(spark, str(tmp_path / "mark")).select(want.columns)
    assert rows(got) == rows(want)


def test_a_batch_costs_its_own_keys(spark, tmp_path):
    """The second batch touches one key of a state of 2000: one row of state is written, one goes to the feed."""
    feed(spark, str(tmp_path / "in"), [change("INSERT", 1, i, "a", i) for i in range(2000)])
    apply(spark, tmp_path, str(tmp_path / "feed"))
    feed(spark, str(tmp_path / "in"), [change("UPDATE", 2, 5000, "b", 7)])
    query = apply(spark, tmp_path, str(tmp_path / "feed"))
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]][-1]
    assert (state["numRowsTotal"], state["numRowsUpdated"]) == (2000, 1)
    assert spark.read.parquet(str(tmp_path / "feed" / "batch=1")).count() == 1
    assert len(live(spark, tmp_path)) == 2000


def test_incremental_load_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "id bigint, part int"
    for part in range(3):
        spark.range(100).withColumn("part", F.lit(part)).write.mode("append").parquet(src)
        jobs.start_incremental(jobs.file_stream(spark, src, schema), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 100 * (part + 1)


def test_closed_windows_of_a_stream_match_the_table(spark, tmp_path, tables, rows):
    landing = str(tmp_path / "in")
    metrics = tables.stream_metrics.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    metrics.repartition(4).write.parquet(landing)
    target = str(tmp_path / "out")
    jobs.start_rollup(jobs.file_stream(spark, landing, metrics.schema), "1 hour", "40 days", target, str(tmp_path / "mark")).awaitTermination()
    # Push the watermark past every window.
    last = metrics.limit(1).withColumn("recorded_at", F.lit("2024-06-01").cast("timestamp"))
    for _ in range(2):
        last.write.mode("append").parquet(landing)
        jobs.start_rollup(jobs.file_stream(spark, landing, metrics.schema), "1 hour", "40 days", target, str(tmp_path / "mark")).awaitTermination()
    assert rows(spark.read.parquet(target)) == rows(jobs.rollup(metrics, "1 hour"))


def test_late_rows_are_kept_apart(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "id int, at timestamp_ntz"
    for rows in ([(1, dt.datetime(2024, 1, 10))], [(2, dt.datetime(2024, 1, 9, 12)), (3, dt.datetime(2024, 1, 1))]):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(src)
        jobs.start_late_split(jobs.file_stream(spark, src, schema), "at", "1 days", out, mark).awaitTermination()
    got = {r.id: str(r.is_late).lower() for r in spark.read.parquet(out).collect()}
    assert got == {1: "false", 2: "false", 3: "true"}


def test_followed_within_as_table_and_stream(spark, tmp_path, rows):
    rnd = random.Random(9)
    # One user has a third of all events; some times are equal, some keys are null.
    events = [(i, 1 if i % 3 == 0 else rnd.choice([2, 3, 4, None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(600)))
              for i in range(300)]
    df = spark.createDataFrame(events, "id int, user int, at timestamp")
    first, second = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    want = sorted((a[0], b[0]) for a in events for b in events if a[0] % 2 == 0 and b[0] % 2 and a[1] is not None and a[1] == b[1]
                  and dt.timedelta(0) < b[2] - a[2] <= dt.timedelta(minutes=45))
    assert rows(jobs.followed_within(first, second, ["user"], "at", 2700).select("first_id", "second_id")) == want
    src = str(tmp_path / "in")
    df.repartition(5).write.parquet(src)
    for _ in range(2):
        stream = jobs.file_stream(spark, src, df.schema, 2)
        jobs.start_followed_within(stream.filter("id % 2 = 0"), stream.filter("id % 2 = 1"), ["user"], "at", 2700, "1 day",
                                   str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("first_id", "second_id")) == want


def test_stalls_are_reported_once(spark, tmp_path, rows):
    from tidemill.streaming import stalls

    def at(minute):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)

    deliveries = [[("a", 0), ("b", 0), ("b", 5), ("b", 70), (None, 3)], [("b", 80)], [("b", 130), ("b", 180), ("a", 185), ("a", 190)], [("b", 400), ("b", 410)]]
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    seen = []
    for part in deliveries:
        spark.createDataFrame([(s, at(m)) for s, m in part], "source string, at timestamp").repartition(2).write.mode("append").parquet(src)
        stream = jobs.file_stream(spark, src, "source string, at timestamp")
        stalls.start_stall_watch(stream, "source", "at", 3600, "0 seconds", out, mark).awaitTermination()
        seen.append(rows(spark.read.parquet(out)))
    # Each stall comes with the delivery that proves it: a's first one by the watermark, long before its next row.
    assert seen[0] == [("a", at(0)), ("b", at(5))] and seen[1] == seen[0] == seen[2]
    want = [("a", at(0)), ("a", at(190)), ("b", at(5)), ("b", at(180))]
    assert seen[3] == want
    table = spark.createDataFrame([(s, at(m), i) for i, (s, m) in enumerate(x for d in deliveries for x in d)], "source string, at timestamp, i int")
    assert rows(stalls.stalls(table, "source", "at", "i", 3600, F.lit(at(410)))) == want
