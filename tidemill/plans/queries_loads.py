"""Queries: scans, landing, record transforms, load modes and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import exprs as x
from tidemill.operators import merge as mg
from tidemill.operators import transforms as tr
from tidemill.plans import marts
from tidemill.plans.oracle import AS_OF, D, R
from tidemill.plans.queries_models import _closed_lines
from tidemill.plans.registry import query
from tidemill.session import scratch_path
from tidemill.sources import json_pages, readers, sinks

_CUST = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s01_csv_scan", f"SELECT c_mktsegment AS segment, count(*) AS n, {R('sum(CAST(c_acctbal AS DECIMAL(18,2)))', 2)} AS balance FROM customer GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.customer.write.csv(path, header=True, sep="|")
    df = readers.read_file(t.spark, path, "csv", schema=_CUST, sep="|")
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), x.rnd(F.sum(x.money(F.col("c_acctbal"))), 2).alias("balance")
    )


@query("s01_csv_inferred_types", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum, max(c_acctbal) AS top FROM customer")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.customer.write.csv(path, header=True)
    df = readers.read_file(t.spark, path, "csv")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").cast("bigint").alias("key_sum"),
                  F.max("c_acctbal").cast("double").alias("top"))


@query("s02_parquet_scan", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    nation = readers.read_file(t.spark, f"{t.sf_dir}/nation.parquet")
    region = readers.read_file(t.spark, f"{t.sf_dir}/region.parquet", "parquet")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query("s03_object_scan", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t):
    # A bucket that is mounted over the folder of the tables; its objects are read by their address, as in any store.
    if "://" in t.sf_dir:
        scheme, rest = t.sf_dir.split("://", 1)
        bucket, _, folder = rest.partition("/")
        found = readers.read_object(t.spark, bucket, f"{folder}/part.parquet", scheme)
    else:
        mount = {"fs.viewfs.mounttable.lake.link./tables": f"file://{t.sf_dir}"}
        found = readers.read_object(t.spark, "lake", "tables/part.parquet", "viewfs", settings=mount)
    return found.groupBy("p_brand").agg(F.count("*").alias("n"))


@query("s05_row_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return readers.row_cap(t.orders.select("o_orderkey", "o_totalprice"), 100, [F.desc("o_totalprice"), "o_orderkey"])


@query("s06_file_counts", """SELECT 'events.parquet' AS file, count(*) AS rows FROM events UNION ALL SELECT 'embeddings.parquet', count(*) FROM embeddings""")
def _(t):
    return readers.file_counts(t.spark, f"{t.sf_dir}/e*.parquet", schema="event_id bigint")


@query("s06_file_counts_csv", "SELECT count(*) AS rows FROM orders")
def _(t):
    path = scratch_path(t.spark, "glob")
    t.orders.write.partitionBy("o_orderstatus").csv(path, header=True)
    # File names hold a random part, so the check adds the counts up.
    return readers.file_counts(t.spark, f"{path}/*/*.csv", "csv").agg(F.sum("rows").alias("rows"))


@query("s08_incremental_extract", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01'""")
def _(t):
    last = F.lit("1998-06-01").cast("timestamp_ntz")
    return readers.since(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", last)


@query("s09_select_extract", f"""SELECT o_orderpriority, count(*) AS n, {D('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS total
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1""")
def _(t):
    return readers.select_sql(t.spark, {"src_orders": t.orders, "src_customer": t.customer}, """
        SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM src_orders JOIN src_customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1""")


def _payloads(t):
    """One JSON payload per customer, in four shapes."""
    key, name = F.col("c_custkey"), F.col("c_name")
    shapes = [
        F.to_json(F.struct(F.struct(F.array(
            F.struct(key.alias("a"), name.alias("b")), F.struct((key + 1).alias("a"), F.lit("x").alias("b"))).alias("rows")).alias("data"))),
        F.to_json(F.struct(F.struct(F.array(key, key * 2).alias("rows")).alias("data"))),
        F.to_json(F.struct(F.struct(F.struct(F.array(key, key + 1).alias("a"), F.array(name, F.lit("y")).alias("b")).alias("rows")).alias("data"))),
        F.to_json(F.struct(F.struct(F.struct(key.alias("a"), name.alias("b")).alias("rows")).alias("data"))),
    ]
    case = F.when(F.lit(False), "")
    for i, s in enumerate(shapes):
        case = case.when(key % 4 == i, s)
    return t.customer.select("c_custkey", case.alias("payload"))


_PAYLOAD_SQL = """p AS (SELECT c_custkey, CASE c_custkey % 4
        WHEN 0 THEN to_json({data: {rows: [{a: c_custkey, b: c_name}, {a: c_custkey + 1, b: 'x'}]}})
        WHEN 1 THEN to_json({data: {rows: [c_custkey, c_custkey * 2]}})
        WHEN 2 THEN to_json({data: {rows: {a: [c_custkey, c_custkey + 1], b: [c_name, 'y']}}})
        ELSE to_json({data: {rows: {a: c_custkey, b: c_name}}}) END AS payload FROM customer),
    n AS (SELECT c_custkey, json_extract(payload, '$.data.rows') AS node FROM p)"""


@query("s10_json_node", f"WITH {_PAYLOAD_SQL} SELECT c_custkey, CAST(node AS VARCHAR) AS node FROM n")
def _(t):
    return _payloads(t).select("c_custkey", json_pages.json_node(F.col("payload"), "data.rows").alias("node"))


@query("s11_json_rows", f"""WITH {_PAYLOAD_SQL},
    l AS (SELECT c_custkey, unnest(json_extract(node, '$[*]')) AS e FROM n WHERE json_type(node) = 'ARRAY'),
    z AS (SELECT c_custkey, node, unnest([0, 1]) AS i FROM n WHERE c_custkey % 4 = 2)
    SELECT c_custkey, json_extract_string(e, '$.a') AS a, json_extract_string(e, '$.b') AS b,
           CASE WHEN json_type(e) <> 'OBJECT' THEN CAST(e AS VARCHAR) END AS value FROM l
    UNION ALL SELECT c_custkey, json_extract_string(node, '$.a[' || i || ']'), json_extract_string(node, '$.b[' || i || ']'), NULL FROM z
    UNION ALL SELECT c_custkey, json_extract_string(node, '$.a'), json_extract_string(node, '$.b'), NULL FROM n WHERE c_custkey % 4 = 3""")
def _(t):
    return json_pages.json_rows(_payloads(t), "payload", "data.rows", ["c_custkey"], ["a", "b", "value"])


def _pages(t):
    """Result pages per order: page number = line number, quantity % 5 items."""
    n = (F.col("l_quantity").cast("int") % 5)
    items = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.col("l_partkey") * 10 + i)) \
        .otherwise(F.array().cast("array<bigint>"))
    return t.lineitem.select(F.col("l_orderkey").alias("feed"), F.col("l_linenumber").alias("page_no"), items.alias("items"))


def _page_sql(limit: int) -> str:
    return f"""WITH p AS (SELECT l_orderkey AS feed, l_linenumber AS page_no, l_partkey, CAST(l_quantity AS INTEGER) % 5 AS n FROM lineitem),
        s AS (SELECT feed, min(page_no) FILTER (WHERE n < {limit}) AS stop FROM p GROUP BY 1)
        SELECT p.feed, p.page_no, l_partkey * 10 + u.i AS item FROM p JOIN s ON p.feed = s.feed
        JOIN (SELECT unnest([1, 2, 3, 4]) AS i) u ON u.i <= p.n WHERE stop IS NULL OR page_no <= stop"""


@query("s12_page_union_until_empty", _page_sql(1))
def _(t):
    return json_pages.union_pages(_pages(t), "feed", "page_no", "items")


@query("s12_page_union_until_short", _page_sql(4))
def _(t):
    return json_pages.union_pages(_pages(t), "feed", "page_no", "items", limit=4)


@query("s13_grid_table", """SELECT CAST(c_custkey AS VARCHAR) AS "key", c_name AS "name",
    CASE WHEN c_nationkey < 12 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def _(t):
    cells = F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    body = t.customer.select((F.col("c_custkey") + 1).alias("row_no"),
                             F.when(F.col("c_nationkey") < 12, F.slice(cells, 1, 2)).otherwise(cells).alias("cells"))
    head = t.spark.range(1).select(F.col("id").alias("row_no"), F.array(*map(F.lit, ["key", "name", "segment"])).alias("cells"))
    return json_pages.grid_table(head.unionByName(body), "row_no", "cells")


@query("s14_alias_mapping", """SELECT o_orderkey AS order_id, 'cust_unknown' AS customer_id, 'General' AS category,
    try_cast(o_orderpriority AS INTEGER) AS quantity, CAST(o_totalprice AS FLOAT) AS total_amount FROM orders""")
def _(t):
    src = t.orders.select(F.col("o_orderkey").alias("ORDER_ID"), F.col("o_orderpriority").alias("qty"),
                          F.col("o_totalprice").alias("total"))
    return readers.map_aliases(src, [
        ("order_id", ["order_id", "id", "orderid"], None, None),
        ("customer_id", ["customer_id", "customerid", "user_id"], None, "cust_unknown"),
        ("category", ["category", "product_category", "dept"], None, "General"),
        ("quantity", ["quantity", "qty", "units"], "int", 1),
        ("total_amount", ["total_amount", "total", "grand_total"], "float", 0.0),
    ])


@query("s15_normalise_names", 'SELECT s_suppkey AS "SUPPLIER_KEY", s_name AS "SUPPLIER_NAME" FROM supplier')
def _(t):
    return readers.normalise_names(t.supplier.select(F.col("s_suppkey").alias("Supplier key"), F.col("s_name").alias("supplier_name")))


@query("s16_lineage_columns", f"SELECT s_suppkey, 'postgresql' AS \"_SOURCE\", {AS_OF} AS \"_INGESTED_AT\", 'run_1' AS \"_RUN_ID\" FROM supplier")
def _(t):
    return readers.with_lineage_columns(t.supplier.select("s_suppkey"), "postgresql", "run_1", t.as_of)


# Columns of each given table.
_LISTED = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
           "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query("s17_catalog_listing", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, {c} AS column_count, (SELECT count(*) FROM {n}) AS row_count" for n, c in _LISTED.items()))
def _(t):
    return readers.catalog_listing({n: t.raw(n) for n in _LISTED})


@query("s18_column_registry", """SELECT table_schema, table_name, c.column_name, data_type, coalesce(description, '') AS description,
    coalesce(example, '') AS example FROM catalog c LEFT JOIN catalog_notes n ON c.column_name = n.column_name""", "catalog catalog_notes")
def _(t):
    return readers.describe_columns(t.catalog, t.catalog_notes)


@query("s19_sample_rows", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3")
def _(t):
    return readers.sample_rows(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


# ---- record transforms -----------------------------------------------------------------------

@query("r01_rename_drop_constant", "SELECT c_custkey AS customer_id, c_name, c_nationkey, c_mktsegment, 'crm' AS origin FROM customer")
def _(t):
    return tr.apply_transforms(t.customer, [
        tr.Rename("c_custkey", "customer_id"), tr.Rename("no_such", "x"), tr.Drop("c_acctbal"), tr.Drop("no_such"),
        tr.AddConstant("origin", "crm"),
    ])


@query("r03_casts", """SELECT id, CAST(trunc(try_cast(num AS DOUBLE)) AS BIGINT) AS num, num IS NOT NULL AND try_cast(num AS DOUBLE) IS NULL AS num__cast_failed,
    lower(flag) IN ('true', '1', 'yes') AS flag, FALSE AS flag__cast_failed
    FROM (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) WHEN 1 THEN event_type
            WHEN 2 THEN '-' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS num,
          ['Yes', 'no', '1', 'TRUE', '0'][event_id % 5 + 1] AS flag FROM events)""")
def _(t):
    text = x.money(F.col("value")).cast("string")
    e = F.col("event_id")
    src = t.events.select(
        e.alias("id"),
        F.when(e % 4 == 0, text).when(e % 4 == 1, F.col("event_type")).when(e % 4 == 2, F.concat(F.lit("-"), text)).alias("num"),
        x.pick(["Yes", "no", "1", "TRUE", "0"], e % 5).alias("flag"),
    )
    return tr.apply_transforms(src, [tr.Cast("num", "integer"), tr.Cast("flag", "boolean"), tr.Cast("absent", "float")])


@query("r05_mappings_filters", """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_quantity AS INTEGER) AS qty
    FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R')""")
def _(t):
    return tr.apply_mappings(
        t.lineitem,
        [{"src": "l_orderkey", "dst": "order_id", "type": "string"}, {"src": "l_quantity", "dst": "qty", "type": "int"}],
        [{"field": "l_quantity", "op": ">=", "value": 10}, {"field": "l_returnflag", "op": "in", "value": ["A", "R"]}],
    )


@query("r06_counted_load", "SELECT count(*) FILTER (WHERE amount IS NOT NULL) AS loaded, count(*) FILTER (WHERE amount IS NULL) AS failed FROM damaged", "damaged")
def _(t):
    got = sinks.load_counted(t.damaged, scratch_path(t.spark, "load"), F.col("amount").isNotNull())
    return t.spark.createDataFrame([(got["loaded"], got["failed"])], "loaded bigint, failed bigint")


@query("r07_throughput", f"""SELECT pipeline_name, {R('CAST(sum(records_loaded) AS DOUBLE) / (CAST(sum(duration_seconds) AS DOUBLE) / 60.0::DOUBLE)', 1)} AS records_per_minute
    FROM runs GROUP BY 1""", "runs")
def _(t):
    per_minute = x.dbl(F.sum("records_loaded")) / (x.dbl(F.sum("duration_seconds")) / 60.0)
    return t.runs.groupBy("pipeline_name").agg(x.rnd(per_minute, 1).alias("records_per_minute"))


# ---- load modes ------------------------------------------------------------------------------

_CAST_TOTAL = f"* REPLACE ({D('total')} AS total)"


@query("k01_append", f"SELECT {_CAST_TOTAL} FROM (SELECT * FROM store_before UNION ALL SELECT * FROM store_delta)", "store_before store_delta")
def _(t):
    table = sinks.VersionedTable(t.spark, scratch_path(t.spark, "append"), create=True)
    table.replace(t.store_before)
    return table.append(t.store_delta)


@query("k02_full_refresh", f"SELECT {_CAST_TOTAL} FROM store_delta", "store_delta")
def _(t):
    table = sinks.VersionedTable(t.spark, scratch_path(t.spark, "refresh"), create=True)
    table.replace(t.store_before)
    return table.replace(t.store_delta)


_LINE_KEYS = ["l_orderkey", "l_linenumber"]
_LINE_COLS = _LINE_KEYS + ["l_partkey", "l_suppkey", "l_returnflag"]


def _batches(t):
    """Lines split by return flag: R lines are the target (deduplicated), the rest arrive."""
    lines = t.lineitem.select(*_LINE_COLS)
    target = mg.pick_one(lines.filter("l_returnflag = 'R'"), _LINE_KEYS, mg.full_order(lines))
    return target, lines.filter("l_returnflag <> 'R'")


_BATCH_SQL = f"""
    l AS (SELECT {', '.join(_LINE_COLS)}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag = 'R'
            ORDER BY {', '.join(_LINE_COLS)}) AS rn FROM lineitem),
    tgt AS (SELECT * EXCLUDE rn FROM l WHERE l_returnflag = 'R' AND rn = 1),
    src AS (SELECT * EXCLUDE rn FROM l WHERE l_returnflag <> 'R' AND rn = 1)"""


@query("k03_insert_ignore", f"""WITH {_BATCH_SQL} SELECT * FROM tgt UNION ALL SELECT * FROM src s
    WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber)""")
def _(t):
    target, arriving = _batches(t)
    return mg.insert_ignore(target, arriving, _LINE_KEYS, mg.full_order(arriving))


@query("k04_insert_or_replace", f"""WITH {_BATCH_SQL} SELECT * FROM src UNION ALL SELECT * FROM tgt t
    WHERE NOT EXISTS (SELECT 1 FROM src s WHERE t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber)""")
def _(t):
    target, arriving = _batches(t)
    return mg.insert_or_replace(target, arriving, _LINE_KEYS, mg.full_order(arriving))


@query("k05_upsert", f"""SELECT {_CAST_TOTAL} FROM (SELECT * FROM store_delta UNION ALL SELECT * FROM store_before b
    WHERE NOT EXISTS (SELECT 1 FROM store_delta d WHERE d.order_key = b.order_key))""", "store_before store_delta")
def _(t):
    return mg.upsert(t.store_before, t.store_delta, ["order_key"])


_MERGED_SQL = """
    m AS (SELECT coalesce(d.order_key, b.order_key) AS order_key,
            CASE WHEN b.order_key IS NULL THEN 'insert' WHEN d.order_key IS NULL THEN 'kept'
                 WHEN (b.customer_id, b.status, b.total) IS DISTINCT FROM (d.customer_id, d.status, d.total) THEN 'update' ELSE 'unchanged' END AS _action,
            b.customer_id AS bc, b.status AS bs, b.total AS bt, b.batch AS bb, d.customer_id AS dc, d.status AS ds, d.total AS dt, d.batch AS db
          FROM store_before b FULL OUTER JOIN store_delta d ON b.order_key = d.order_key)"""


@query("k06_hash_merge", f"""WITH {_MERGED_SQL} SELECT order_key, CASE WHEN _action IN ('insert', 'update') THEN dc ELSE bc END AS customer_id,
    CASE WHEN _action IN ('insert', 'update') THEN ds ELSE bs END AS status, {D("CASE WHEN _action IN ('insert', 'update') THEN dt ELSE bt END")} AS total,
    CASE WHEN _action IN ('insert', 'update') THEN db ELSE bb END AS batch, _action FROM m""", "store_before store_delta")
def _(t):
    return mg.merge(t.store_before, t.store_delta, ["order_key"], [F.desc("batch")], skip=["batch"])


@query("k06_hash_merge_in_zones", f"""WITH {_MERGED_SQL} SELECT order_key, CASE WHEN _action IN ('insert', 'update') THEN dc ELSE bc END AS customer_id,
    CASE WHEN _action IN ('insert', 'update') THEN ds ELSE bs END AS status, {D("CASE WHEN _action IN ('insert', 'update') THEN dt ELSE bt END")} AS total,
    CASE WHEN _action IN ('insert', 'update') THEN db ELSE bb END AS batch FROM m""", "store_before store_delta")
def _(t):
    # Zones are ranges of keys; the batch comes in two parts, the second of which repeats rows of the first.
    path, zone = scratch_path(t.spark, "zones"), F.floor(F.col("order_key") / 4096)
    sinks.create_zoned(t.store_before, path, zone)
    for part in (t.store_delta.filter(F.col("order_key") % 3 > 0), t.store_delta):
        sinks.merge_zoned(t.spark, path, part, ["order_key"], [F.desc("batch")], zone, ("batch",))
    return t.spark.read.parquet(path).drop("zone")


@query("k07_merge_stats", f"""WITH {_MERGED_SQL}, c AS (SELECT (SELECT count(*) FROM store_delta) AS ingested,
    count(*) FILTER (WHERE _action = 'insert') AS inserts, count(*) FILTER (WHERE _action = 'update') AS updates FROM m)
    SELECT *, greatest(ingested - inserts - updates, 0) AS unchanged, inserts + updates AS loaded FROM c""", "store_before store_delta")
def _(t):
    return mg.merge_stats(mg.merge(t.store_before, t.store_delta, ["order_key"], [F.desc("batch")], skip=["batch"]))


_SK = "md5(concat_ws('||', CAST(order_id AS VARCHAR), coalesce(CAST(customer_id AS VARCHAR), ''), coalesce(CAST(amount AS VARCHAR), ''), coalesce(category, '')))"


@query("k08_surrogate_key", f"SELECT order_id, {_SK} AS row_key FROM damaged", "damaged")
def _(t):
    df = t.damaged.drop("event_time")
    return df.select("order_id", mg.surrogate_key(df).alias("row_key"))


@query("k09_choose_key", f"SELECT count(*) AS n, count(DISTINCT {_SK}) AS surrogate_keys, count(DISTINCT event_time) AS cursor_keys FROM damaged", "damaged")
def _(t):
    by_hash, hash_key = mg.choose_key(t.damaged.drop("event_time"), "updated_at")
    by_cursor, cursor_key = mg.choose_key(t.damaged, "event_time")
    distinct_cursor = by_cursor.agg(F.count_distinct(cursor_key)).scalar()
    return by_hash.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(hash_key).alias("surrogate_keys")) \
        .withColumn("cursor_keys", distinct_cursor)


_CUT = "TIMESTAMP '2024-01-15'"


@query("k10_high_water_mark", f"""WITH m AS (SELECT pipeline_name, max(started_at) AS old_mark FROM runs
        WHERE started_at < {_CUT} AND source_type <> 'csv' GROUP BY 1)
    SELECT r.pipeline_name, old_mark, count(*) AS rows, max(started_at) AS new_mark,
           CASE WHEN old_mark IS NULL THEN 'initial' ELSE 'incremental' END AS load_mode
    FROM runs r LEFT JOIN m ON r.pipeline_name = m.pipeline_name WHERE old_mark IS NULL OR started_at > old_mark GROUP BY 1, 2""", "runs")
def _(t):
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    marks = t.runs.filter((F.col("started_at") < cut) & (F.col("source_type") != "csv")) \
        .groupBy("pipeline_name").agg(F.max("started_at").alias("value"))
    return sinks.advance_marks(t.runs, marks, ["pipeline_name"], "started_at")


@query("k11_load_mode", """SELECT pipeline_name, started_at, CASE WHEN row_number() OVER (PARTITION BY pipeline_name ORDER BY started_at, run_no) = 1
    THEN 'initial' ELSE 'incremental' END AS load_mode FROM runs""", "runs")
def _(t):
    first = t.runs.groupBy("pipeline_name").agg(F.min(F.struct("started_at", "run_no")).alias("first_run"))
    is_first = F.col("first_run") == F.struct("started_at", "run_no")
    return t.runs.join(first, "pipeline_name").select(
        "pipeline_name", "started_at", F.when(is_first, "initial").otherwise("incremental").alias("load_mode"))


@query("k13_runs_by_day", """SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, count(*) AS runs, CAST(sum(records_loaded) AS BIGINT) AS loaded FROM runs
    WHERE CAST(started_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY 1""", "runs")
def _(t):
    path = scratch_path(t.spark, "runs")
    sinks.write_by_day(t.runs, path, "started_at")
    week = sinks.read_days(t.spark, path, "2024-01-10", "2024-01-16")
    return week.groupBy("day").agg(F.count("*").alias("runs"), F.sum("records_loaded").alias("loaded"))


@query("k13_run_row", """SELECT 'orders_load' AS pipeline_name, count(*) AS records_ingested, count(amount) AS records_loaded,
    count(*) - count(amount) AS records_failed, 'warning' AS status, TIMESTAMP '2024-01-30 00:00:00' AS started_at,
    TIMESTAMP '2024-01-30 00:10:00' AS completed_at, 600::BIGINT AS duration_seconds FROM damaged""", "damaged")
def _(t):
    def at(text):
        return F.lit(text).cast("timestamp_ntz")

    return sinks.run_row(t.damaged, t.damaged.filter(F.col("amount").isNotNull()), "orders_load",
                         at("2024-01-30 00:00:00"), at("2024-01-30 00:10:00"))


@query("k14_dead_letter", f"""SELECT order_id, {AS_OF} AS failed_at, CASE WHEN customer_id IS NULL THEN 'customer missing' ELSE 'amount not positive' END AS error
    FROM damaged WHERE customer_id IS NULL OR NOT coalesce(amount > 0, FALSE)""", "damaged")
def _(t):
    letters = mg.dead_letters(t.damaged, {"customer missing": F.col("customer_id").isNotNull(), "amount not positive": F.col("amount") > 0},
                              ["order_id"], t.as_of)
    return letters.select("order_id", "failed_at", "error")


@query("k14_open_letters", """SELECT event_id, failed_at, error FROM (SELECT event_id, ts AS failed_at, CASE WHEN event_type = 'error' THEN 'error event' ELSE 'value too small' END AS error
    FROM events WHERE event_type = 'error' OR value < 5) WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 100) ORDER BY failed_at DESC, event_id LIMIT 50""")
def _(t):
    letters = mg.dead_letters(t.events, {"error event": F.col("event_type") != "error", "value too small": F.col("value") >= 5}, ["event_id"], F.col("ts"))
    return mg.open_letters(letters, t.events.filter(F.col("value") > 100), ["event_id"], 50).select("event_id", "failed_at", "error")


@query("k12_target_types", """SELECT column_name, loaded_type, (SELECT count(*) FROM orders) AS row_count FROM (VALUES ('o_orderkey', 'BIGINT'), ('o_custkey', 'BIGINT'),
    ('o_orderstatus', 'TEXT'), ('o_totalprice', 'DOUBLE PRECISION'), ('o_orderdate', 'TIMESTAMPTZ'), ('o_orderpriority', 'TEXT'),
    ('_SOURCE', 'TEXT'), ('_INGESTED_AT', 'TIMESTAMPTZ'), ('_RUN_ID', 'TEXT')) v(column_name, loaded_type)""")
def _(t):
    types = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(d).alias("loaded_type")) for c, d in sinks.loaded_types(t.orders).items()])
    return t.orders.agg(F.count("*").alias("row_count")).select(F.inline(types), "row_count")


@query("k15_reconcile", """WITH c AS (SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM damaged) AS dest_rows
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders)
    UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part))
    SELECT *, source_rows = dest_rows AS matched FROM (SELECT * FROM c UNION ALL
        SELECT 'TOTAL', CAST(sum(source_rows) AS BIGINT), CAST(sum(dest_rows) AS BIGINT) FROM c)""", "damaged")
def _(t):
    return mg.reconcile({"orders": t.orders, "customer": t.customer, "part": t.part},
                        {"orders": t.damaged, "customer": t.orders.select("o_custkey").distinct(), "part": t.part})


@query("k16_recent_loads", """SELECT id, started_at, records_loaded, status FROM runs WHERE pipeline_name = 'kafka_consumer'
    ORDER BY started_at DESC, run_no DESC LIMIT 20""", "runs")
def _(t):
    return sinks.recent_loads(t.runs, "kafka_consumer", 20).select("id", "started_at", "records_loaded", "status")


@query("k17_daily_upsert", f"""SELECT CAST(CAST(o.created_at AS DATE) AS VARCHAR) AS day, o.region, count(DISTINCT o.id) AS total_orders,
           {D('sum(CAST(i.quantity * i.unit_price AS DECIMAL(18,2)))')} AS total_revenue
    FROM shop_items i JOIN shop_orders o ON i.order_id = o.id JOIN shop_products p ON i.product_id = p.id
    WHERE o.status <> 'cancelled' GROUP BY 1, 2""", "shop_items shop_orders shop_products")
def _(t):
    daily = marts.daily_metrics(_closed_lines(t)).select("day", "region", "total_orders", "total_revenue")
    table = sinks.VersionedTable(t.spark, scratch_path(t.spark, "daily"), create=True)
    before = table.replace(daily.filter(F.col("day") < F.lit("1998-01-01").cast("date")).withColumn("total_revenue", F.lit(0.0)))
    return mg.upsert(before, daily, ["day", "region"])
