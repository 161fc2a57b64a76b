"""Isolation forest, classifier, retrieval, reachability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import isolation_forest as iso
from tidemill.operators import lineage as ln
from tidemill.operators import recall_index as ri
from tidemill.operators import retrieval as rt
from tidemill.operators import run_model as rm
from tidemill.plans import build


def test_forest_finds_far_points_and_is_reproducible(spark):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(0, 1, (600, 2)), rng.normal(12, 0.5, (20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    forest = iso.fit(df, ["a", "b"], "id", trees=60)
    scored = iso.decide(iso.score(forest, df, "id"), 20 / 620)
    far = {r.id for r in scored.filter("is_outlier").collect()}
    assert len(far & set(range(600, 620))) >= 18
    again = iso.fit(df.repartition(3), ["a", "b"], "id", trees=60)
    x = points[:50]
    assert np.allclose(forest.scores(x), again.scores(x))


def test_average_path():
    assert iso.average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert iso.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_classifier_learns_the_labels(spark, tables):
    half = F.floor(F.col("records_ingested") / 2)
    runs = tables.runs.withColumn("records_loaded", F.when(F.col("status") == "failed", half).otherwise(F.col("records_loaded")))
    train, test = rm.split(rm.balance(rm.training_set(runs)))
    scored = rm.predict(rm.fit_classifier(train, trees=10, depth=6), test)
    assert rm.overall_scores(scored).first().accuracy > 0.85
    assert scored.filter("confidence < 0 OR confidence > 1").count() == 0


def test_outlier_typing(spark):
    def kind(message, predicted):
        return spark.range(1).select(rm.anomaly_type(F.lit(message), F.lit(predicted)).alias("k")).first().k

    assert kind("disk full", "NULL_SPIKE") == "RATE_LIMIT_HIT"
    assert kind("no such text", "NULL_SPIKE") == "NULL_SPIKE"
    assert kind(None, "NORMAL") == "ML_ANOMALY"


def test_recall_matches_brute_force_on_both_paths(spark):
    rng = np.random.default_rng(4)
    q, s = rng.normal(size=(9, 6)), rng.normal(size=(300, 6))
    tags = [str(i % 3) for i in range(300)]
    queries = spark.createDataFrame([(i, v.tolist(), None if i % 2 else str(i % 3)) for i, v in enumerate(q)], "query_id int, embedding array<double>, tag string")
    store = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(s, tags))], "item_id int, embedding array<double>, tag string")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit(q) @ unit(s).T
    want = set()
    for i in range(9):
        ok = [j for j in range(300) if d[i, j] <= 0.6 and (i % 2 or tags[j] == str(i % 3))]
        want |= {(i, j) for j in sorted(ok, key=lambda j: d[i, j])[:3]}
    for kwargs in ({}, {"max_queries": 2, "block_rows": 40}):
        got = {(r.query_id, r.item_id) for r in rt.recall(queries, store, 3, 0.6, **kwargs).collect()}
        assert got == want


def test_reuse_gate(spark):
    near = spark.createDataFrame([(1, 1, 0.05, 1), (2, 2, 0.2, 1), (1, 3, 0.06, 2)], "query_id int, item_id int, distance double, rank int")
    assert [r.query_id for r in rt.reusable(near).collect()] == [1]


def test_reach_handles_cycles_and_shortest_depth(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",)], "seed string")
    assert rows(ln.reach(seeds, edges)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("x", "y", 1)]


def test_a_deep_chain_is_followed_to_its_end(spark):
    edges = spark.range(40).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst")
    seeds = spark.createDataFrame([("n0",)], "seed string")
    found = ln.reach(seeds, edges)
    assert found.count() == 40 and found.agg(F.max("depth")).first()[0] == 40
    with pytest.raises(RecursionError):
        ln.reach(seeds, edges, guard=5)


def test_models_come_after_what_they_read():
    order = build.build_order()
    assert len(order) == len(build.MODELS) == 17
    place = {name: i for i, name in enumerate(order)}
    assert all(place[r] < place[name] for name, (_, reads) in build.MODELS.items() for r in reads if r in place)
    with pytest.raises(Exception, match="cycle"):
        build.build_order({"a": (None, ["b"]), "b": (None, ["a"])})


@pytest.mark.parametrize("rows", [100, 512, 2000, 60_000])
def test_every_tree_draws_from_all_rows(spark, rows):
    df = spark.range(rows).select("id", F.col("id").cast("double").alias("x")).repartition(3)
    drawn = iso.draw(df, "id", 20, 256, 7)
    sizes = {r.tree: r.n for r in drawn.groupBy("tree").agg(F.count("*").alias("n")).collect()}
    assert sizes == dict.fromkeys(range(20), min(256, rows))
    assert drawn.select("tree", "id").distinct().count() == drawn.count()
    again = iso.draw(df.repartition(5), "id", 20, 256, 7)
    assert sorted(map(tuple, again.select("tree", "id").collect())) == sorted(map(tuple, drawn.select("tree", "id").collect()))
    if rows > 20 * 256:
        assert drawn.select("id").distinct().count() > 15 * 256


def test_nearest_items_are_kept_per_task(spark):
    rng = np.random.default_rng(3)
    items = [(i, rng.normal(size=4).tolist(), None, i % 7 == 0) for i in range(3000)] + [(9000, None, None, False), (9001, [], None, False)]
    store = spark.createDataFrame(items, "item_id long, embedding array<double>, tag string, deprecated boolean").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], None), (2, None, None), (3, [0.0, 1.0, 1.0, 0.0], None)],
                                    "query_id long, embedding array<double>, tag string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        one_task = rt._by_broadcast(queries.filter("embedding is not null"), store.filter("size(embedding) > 0").drop("deprecated"), 5, 2.0)
        assert one_task.count() == 2 * 5
        found = rt.recall(queries, store, k=5, max_distance=2.0)
        blocks = rt.recall(queries, store, k=5, max_distance=2.0, max_queries=1, block_rows=500)
        rows = sorted((r.query_id, r.rank, r.item_id) for r in found.collect())
        assert rows == sorted((r.query_id, r.rank, r.item_id) for r in blocks.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = np.array([v for _, v, _, old in items if v and not old])
    ids = np.array([i for i, v, _, old in items if v and not old])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q_id, v in ((1, [1.0, 0, 0, 0]), (3, [0, 1.0, 1, 0])):
        d = 1 - unit @ (np.array(v) / np.linalg.norm(v))
        assert [r[2] for r in rows if r[0] == q_id] == ids[np.lexsort((ids, np.round(d, 9)))[:5]].tolist()


def _clustered(spark, n=4000):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 16)) * 3
    # A third of all vectors lie at one place.
    points = np.where(rng.random(n)[:, None] < 0.33, middle[0], middle[rng.integers(0, 40, n)]) + rng.normal(size=(n, 16)) * 0.3
    rows = [(i, v.tolist(), str(i % 2)) for i, v in enumerate(points)]
    return spark.createDataFrame(rows, "item_id long, embedding array<double>, tag string")


def test_index_finds_nine_of_ten_in_few_lists(spark, tmp_path):
    store = _clustered(spark)
    centres, probes = ri.fit(store)
    ri.build(store, centres).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert len(centres) == 63 and probes < 20 and index.count() == 4000
    queries = store.filter("item_id % 100 = 0").selectExpr("item_id AS query_id", "embedding", "CAST(NULL AS STRING) AS tag")
    exact = rt.recall(queries, store, 10, 2.0)
    for blocks in ({}, {"max_queries": 3, "block_rows": 200}):
        found = ri.search(queries, index, centres, probes, 10, **blocks)
        assert ri.measured_recall(found, exact).first().recall >= 0.9
    whole = ri.search(queries, index, centres, len(centres), 10, max_queries=3, block_rows=200)
    assert {tuple(r)[:2] for r in whole.collect()} == {tuple(r)[:2] for r in exact.collect()}


def test_index_tags_nulls_and_empty_tables(spark, tmp_path):
    store = _clustered(spark, 200).unionByName(spark.createDataFrame(
        [(900, None, "0"), (901, [], "0")], "item_id long, embedding array<double>, tag string")).withColumn("deprecated", F.col("item_id") == 7)
    centres, _ = ri.fit(store, lists=5)
    ri.build(store, centres).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 199
    queries = store.filter("item_id IN (4, 7, 900)").select(F.col("item_id").alias("query_id"), "embedding", "tag")
    rows = ri.search(queries, index, centres, 5, 3).collect()
    assert {r.query_id for r in rows} == {4, 7} and all(r.item_id % 2 == r.query_id % 2 and r.item_id != 7 for r in rows)
    empty, probes = ri.fit(store.limit(0))
    assert len(empty) == 0 and probes == 1 and ri.build(store.limit(0), centres).count() == 0


def test_training_rows_are_dealt_by_number_not_by_label(spark):
    # Nearly all rows have one label, many are copies of one another.
    train = spark.range(90_000).selectExpr("id % 7 AS run_no", "CASE WHEN id < 50 THEN 'DELAY' ELSE 'NORMAL' END AS label", *[
        f"CAST(1 AS DOUBLE) AS {c}" for c in rm.CLASSIFIER_FEATURES])
    weighted = rm.weigh(train)
    held = [r[0] for r in weighted.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(held) == 90_000 and max(held) <= rm.LEAST_ROWS + 100
    assert {r.label: r.weight for r in weighted.select("label", "weight").distinct().collect()} == {"DELAY": 900.0, "NORMAL": 90_000 / (89_950 * 2)}


def test_large_training_rows_fill_no_task(spark):
    tasks = rm.dealt(spark.range(1000), 1000, most=10, least=5).rdd.glom().map(len).collect()
    assert sum(tasks) == 1000 and len(tasks) == 100 and max(tasks) <= 20


def test_lines_of_the_summary_are_dealt_by_size_before_they_are_counted(spark):
    from tidemill.plans import marts

    lines = spark.range(100).selectExpr("timestamp'2024-01-01' AS ordered_at", "'a' AS category", "'b' AS city", "id % 10 AS order_id", "id % 5 AS customer_id",
                                        "1 AS quantity", "CAST(2 AS DECIMAL(18,2)) AS total_amount", "true AS is_completed", "'shipped' AS status")
    got = marts.fct_ecommerce_summary(lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan
    (row,) = got.collect()
    assert (row.order_count, row.unique_customers, row.total_units_sold, row.total_revenue, row.completed_orders) == (10, 5, 100, 200.0, 100)


def test_raw_sources_of_a_build_are_written_once_and_views_read_what_was_written(spark, tmp_path):
    at = "timestamp_ntz'2024-01-03 10:00:00'"
    trips = spark.range(6).selectExpr(
        "id", "1 AS vendor_id", f"{at} AS pickup_datetime", f"{at} + INTERVAL '10' MINUTE AS dropoff_datetime", "2.0D AS passenger_count",
        "1.5D AS trip_distance", "1 AS pu_location_id", "2 AS do_location_id", "1 AS payment_type", "8.0D AS fare_amount", "1.0D AS tip_amount",
        "9.0D AS total_amount")
    # Lines 0 and 4 have one id, line 5 has none.
    lines = spark.range(6).selectExpr("CASE WHEN id < 5 THEN id % 4 END AS id", "id % 3 AS order_id", "id % 2 AS customer_id", "id % 2 AS product_id")
    names = spark.range(2).selectExpr(
        "id AS product_id", "'lamp' AS product_name", "' home ' AS category", "2.0D AS unit_price", "3 AS quantity",
        "CAST(6 AS DECIMAL(18,2)) AS total_amount", "'shipped' AS status", "'Rome' AS city", "'IT' AS country", f"{at} AS created_at")
    sources = {
        "raw_trips": trips, "raw_orders": lines.join(names, "product_id"),
        "shop_items": lines.selectExpr("order_id", "product_id", "3 AS quantity", "CAST(2 AS DECIMAL(18,2)) AS unit_price"),
        "shop_products": names.selectExpr("product_id AS id", "category"),
        "shop_orders": lines.selectExpr("order_id AS id", "customer_id", "CAST(6 AS DECIMAL(18,2)) AS order_total", "'shipped' AS status", f"{at} AS created_at"),
    }
    tested = build.build_models(sources, str(tmp_path))
    for view, raw in (("stg_trips", "raw_trips"), ("stg_orders", "raw_orders")):
        files = spark.table(view).inputFiles()
        assert files and all(f"{tmp_path}/{raw}/" in f for f in files)
        assert "Join" not in spark.table(view)._jdf.queryExecution().optimizedPlan().toString()
    failed = {(r.model, r.column, r.test): r.failures for r in tested.filter("status = 'fail'").collect()}
    assert failed == {(m, c, t): 1 for m, c in (("raw_orders", "id"), ("stg_orders", "order_key")) for t in ("not_null", "unique")}
    assert tested.count() == 38 and spark.read.parquet(f"{tmp_path}/fct_orders").count() == 6


def test_findings_beside_the_model_fail_without_its_outliers(spark, tmp_path, monkeypatch, rows):
    from tidemill.operators import anomalies as an
    from tidemill.plans import queries_model_stream as qs
    from tidemill.plans.catalog import QUERIES

    # Ten flows with three runs each; the newest run of flow 3 failed with a text that names a type.
    spark.range(30).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts", "id % 10 AS user_id",
        "CASE WHEN id = 23 THEN 'error' ELSE 'view' END AS event_type", "50.0D + id AS value", """'{"k": 50}' AS props""",
    ).write.parquet(str(tmp_path / "events.parquet"))
    # Runs 5 (not the newest), 21 and 23 are outliers.
    scores = spark.range(30).selectExpr("id AS run_no", "CASE WHEN id IN (5, 21, 23) THEN -0.2D ELSE 0.1D END AS decision", "id IN (5, 21, 23) AS is_outlier")
    monkeypatch.setattr(qs, "_scored", lambda t: scores)
    monkeypatch.setattr(qs.rm, "fit_classifier", lambda train: None)
    monkeypatch.setattr(qs.rm, "predict", lambda model, df: df.selectExpr("*", "'NORMAL' AS predicted", "0.5D AS confidence"))

    def result():
        found = QUERIES["a14_findings_beside_the_model"](spark, str(tmp_path))
        return rows(found.filter("rule <> 'model_outlier'")), {r.run_no: r.as_scored for r in found.filter("rule = 'model_outlier'").collect()}

    by_rules, checked = result()
    assert checked == dict.fromkeys(range(20, 30), True)
    whole = an.with_model_outliers
    monkeypatch.setattr(an, "with_model_outliers", lambda findings, outliers: findings)
    assert result() == (by_rules, {**checked, 21: False, 23: False})
    monkeypatch.setattr(an, "with_model_outliers", lambda f, o: whole(f, o.withColumn("anomaly_type", F.lit("ML_ANOMALY"))))
    assert result() == (by_rules, {**checked, 23: False})
    monkeypatch.setattr(an, "with_model_outliers", lambda f, o: whole(f, o.withColumn("run_no", F.col("run_no") + 1)))
    assert result()[1] == {**checked, **dict.fromkeys((21, 22, 23, 24), False)}
