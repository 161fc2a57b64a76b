"""Queries: remediation of damaged tables and validation of the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.exprs import rnd
from tidemill.operators import remediate as fx
from tidemill.operators import validate as va
from tidemill.plans.oracle import ORDERS_AS_OF, R
from tidemill.plans.registry import query

_COLS = "order_id customer_id amount category event_time".split()
_MED = "(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {t})"


def _fill(c: str, table: str) -> str:
    return f"coalesce(CAST({c} AS DOUBLE), {_MED.format(c=c, t=table)})"


_F1 = f"""SELECT order_id, {_fill('customer_id', 'damaged')} AS customer_id, {_fill('amount', 'damaged')} AS amount,
    coalesce(category, 'UNKNOWN') AS category, coalesce(event_time, TIMESTAMP '1970-01-01') AS event_time FROM damaged"""


@query("f01_schema_change", _F1, "damaged")
def _(t):
    return fx.schema_change(t.damaged)


@query("f01_schema_change_numeric_text", "SELECT order_id, CAST(o AS DOUBLE) AS code, ('x' || o) AS label FROM (SELECT o_orderkey AS order_id, o_custkey AS o FROM orders)")
def _(t):
    return fx.schema_change(t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").cast("string").alias("code"),
        F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("label")))


_F2 = f"""u AS (SELECT DISTINCT * FROM damaged),
    q AS (SELECT order_id, {_fill('customer_id', 'u')} AS customer_id, {_fill('amount', 'u')} AS amount,
        trim(coalesce(category, 'UNKNOWN')) AS category, event_time FROM u)"""


@query("f02_data_quality", f"WITH {_F2} SELECT * FROM q", "damaged")
def _(t):
    return fx.data_quality(t.damaged)


@query("f03_connection", "SELECT order_id, customer_id, amount, category, event_time FROM damaged", "damaged")
def _(t):
    return fx.connection(t.damaged.withColumn("nothing", F.lit(None).cast("string")))


@query("f04_volume", "SELECT customer_id, amount, category FROM damaged WHERE NOT (customer_id IS NULL AND amount IS NULL AND category IS NULL)", "damaged")
def _(t):
    return fx.volume(t.damaged.select("customer_id", "amount", "category"))


@query("f05_timeout_types", """SELECT order_id, customer_id, CAST(CAST(amount AS FLOAT) AS DOUBLE) AS amount,
    'float' AS amount_type, CASE WHEN (SELECT max(order_id) FROM damaged) < 128 THEN 'tinyint'
        WHEN (SELECT max(order_id) FROM damaged) < 32768 THEN 'smallint' WHEN (SELECT max(order_id) FROM damaged) < 2147483648 THEN 'int' ELSE 'bigint' END AS key_type
    FROM damaged""", "damaged")
def _(t):
    # The row limit has its own query; here every row stays.
    fixed = fx.timeout(t.damaged.select("order_id", "customer_id", "amount"), max_rows=10**15)
    types = dict(fixed.dtypes)
    return fixed.select(F.col("order_id").cast("bigint"), F.col("customer_id").cast("bigint"), F.col("amount").cast("double"),
                        F.lit(types["amount"]).alias("amount_type"), F.lit(types["order_id"]).alias("key_type"))


@query("f05_timeout_sample", "SELECT least(count(*), 5000) AS n, TRUE AS all_known, TRUE AS repeatable FROM lineitem")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    fixed = fx.timeout(lines, max_rows=5000)
    again = fx.timeout(lines.repartition(7), max_rows=5000)
    known = lines.distinct()
    same = [F.col(c).cast(dict(known.dtypes)[c]).alias(c) for c in known.columns]
    missing = fixed.select(*same).join(known, known.columns, "left_anti").agg(F.count("*")).scalar()
    sums = [x.select(F.sum(F.xxhash64(*(c.cast("bigint") for c in same)).cast("decimal(38,0)"))).scalar() for x in (fixed, again)]
    return fixed.agg(F.count("*").alias("n")).withColumn("all_known", missing == 0).withColumn("repeatable", sums[0] == sums[1])


@query("f06_logic", """SELECT DISTINCT order_id, coalesce(customer_id, 0) AS customer_id, coalesce(amount, 0) AS amount, trim(category) AS category, event_time FROM damaged""", "damaged")
def _(t):
    return fx.logic(t.damaged)


@query("f07_rate_limit", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 10000")
def _(t):
    return fx.rate_limit(t.events, ["ts", "event_id"]).select("event_id", "value")


_LATEST = """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {t} DESC NULLS LAST, {cols}) AS rn FROM {src}) WHERE rn = 1"""


def _nulls_first(cols) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)




@query("f08_cdc_lag", _LATEST.format(k="key", t="event_time", cols=_nulls_first(['"offset"', "key", "op", "event_time", "payload"]), src="changes"), "changes")
def _(t):
    return fx.cdc_lag(t.changes, "key", "event_time")


_REC = ["customer_id", "order_id", "amount", "event_time"]


@query("f09_incremental_sync", f"""SELECT * EXCLUDE rn FROM (SELECT {', '.join(_REC)}, row_number() OVER (PARTITION BY customer_id
    ORDER BY event_time DESC NULLS LAST, {_nulls_first(_REC)}) AS rn FROM damaged WHERE event_time >= {ORDERS_AS_OF} - INTERVAL 7 DAY) WHERE rn = 1""", "damaged")
def _(t):
    return fx.incremental_sync(t.damaged.select(*_REC), t.orders_as_of, "customer_id", "event_time")


@query("f10_cascading", """SELECT order_id, coalesce(customer_id, -1) AS customer_id, coalesce(amount, -1) AS amount, coalesce(category, 'RECOVERY_SENTINEL') AS category,
    coalesce(CAST(event_time AS VARCHAR), 'RECOVERY_SENTINEL') AS event_time FROM damaged""", "damaged")
def _(t):
    return fx.cascading(t.damaged)


@query("f11_checkpoint", "SELECT DISTINCT * FROM damaged", "damaged")
def _(t):
    return fx.checkpoint(t.damaged, "event_time")


@query("f12_duplicate_spike_by_key", _LATEST.format(k="order_id", t="event_time", cols=_nulls_first(_COLS), src="damaged"), "damaged")
def _(t):
    return fx.duplicate_spike(t.damaged, ["order_id"], "event_time")


@query("f12_duplicate_spike_by_content", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(t):
    return fx.duplicate_spike(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("f13_flatten_json_text", "SELECT event_id, k AS props__k, CASE WHEN k % 2 = 0 THEN event_type END AS props__at__kind FROM ev", "ev")
def _(t):
    flat = fx.snowflake_schema(t.events.select("event_id", F.when(
        F.get_json_object("props", "$.k").cast("int") % 2 == 0,
        F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.struct(F.col("event_type").alias("kind")).alias("at"))),
    ).otherwise(F.col("props")).alias("props")))
    return flat.select("event_id", "props__k", F.col("`props__at.kind`").alias("props__at__kind"))


@query("f14_bigquery_type", """SELECT event_id, CASE WHEN k % 10 <> 0 THEN CAST(CAST(value AS DECIMAL(38,9)) AS DOUBLE) END AS code, ts AS seen_time, event_type FROM ev""", "ev")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return fx.bigquery_type(t.events.select(
        "event_id", F.when(k % 10 != 0, F.col("value").cast("string")).otherwise("n/a").alias("code"),
        F.col("ts").cast("string").alias("seen_time"), "event_type"))


@query("f15_mysql_cdc", """SELECT user_id AS id, ts AS created_at, flag, event_id AS _binlog_position FROM (SELECT *, event_type = 'error' AND k <> 7 AS flag,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1""", "ev")
def _(t):
    return fx.mysql_cdc(t.events.select(
        F.col("user_id").alias("id"), F.col("ts").cast("string").alias("created_at"),
        F.when(F.get_json_object("props", "$.k").cast("int") == 7, 5).when(F.col("event_type") == "error", 1).otherwise(0).alias("flag"),
        F.col("event_id").alias("_binlog_position")))


@query("f16_mongodb_flatten", "SELECT event_id, event_type AS doc_kind, value AS doc_in_amount, CASE WHEN k % 3 = 0 THEN 'null' ELSE CAST(k AS VARCHAR) END AS rest FROM ev", "ev")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    nested = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("value").alias("amount")).alias("in"))
    flat = fx.mongodb_flatten(t.events.select("event_id", nested.alias("doc"), F.when(k % 3 != 0, k).alias("rest")))
    return flat.select("event_id", F.col("`doc.kind`").alias("doc_kind"), F.col("`doc.in.amount`").alias("doc_in_amount"), "rest")


@query("f17_redshift_load", """SELECT doc_id, length(t) AS chars FROM (SELECT doc_id, left(text, 65535) AS t FROM documents)
    WHERE NOT regexp_matches(replace(t, ' ', ''), '[\\p{C}\\p{Z}]')""")
def _(t):
    return fx.redshift_load(t.documents.select("doc_id", "text")).select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("f18_partition_skew", """WITH s AS (SELECT CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) ELSE 'rest' END AS part_key FROM events),
    n AS (SELECT part_key, count(*) AS rows FROM s GROUP BY 1)
    SELECT part_key, rows, CAST(CASE WHEN rows > 5 * (SELECT avg(rows) FROM n) THEN 8 ELSE 1 END AS BIGINT) AS salts FROM n""")
def _(t):
    keyed = t.events.select(F.when(F.col("event_type") == "error", F.col("user_id").cast("string")).otherwise("rest").alias("part_key"))
    return fx.partition_skew(keyed, "part_key").groupBy("part_key").agg(
        F.count("*").alias("rows"), F.count_distinct("_partition_salt").alias("salts"))


def _measures_sql(source: str, cols) -> str:
    shares = [f"(count(*) - count({c})) / CAST(count(*) AS DOUBLE)" for c in cols]
    return f"""SELECT count(*) AS rows, {len(cols)} AS columns, {' + '.join(f'(count(*) - count({c}))' for c in cols)} AS null_cells,
        greatest({', '.join(shares)}) AS max_null_share, ({' + '.join(shares)}) / {len(cols)} AS mean_null_share,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS copies FROM {source}"""


@query("v01_verify_remedies", f"""WITH {_F2}, a AS ({_F1}), l AS (SELECT DISTINCT order_id, coalesce(customer_id, 0) AS customer_id, coalesce(amount, 0) AS amount, trim(category) AS category, event_time FROM damaged),
    m AS (SELECT 'schema_change' AS remedy, * FROM ({_measures_sql('a', _COLS)}) UNION ALL SELECT 'data_quality', * FROM ({_measures_sql('q', _COLS)})
          UNION ALL SELECT 'logic', * FROM ({_measures_sql('l', _COLS)}))
    SELECT remedy, rows, columns, null_cells, {R('max_null_share', 4)} AS max_null_share, {R('mean_null_share', 4)} AS mean_null_share, copies,
        CASE remedy WHEN 'schema_change' THEN rows > 0 AND max_null_share < 0.15 WHEN 'data_quality' THEN rows > 0 AND null_cells = 0
             ELSE rows > 0 AND copies = 0 END AS passed FROM m""", "damaged")
def _(t):
    out = None
    for name, fix in (("schema_change", fx.schema_change), ("data_quality", fx.data_quality), ("logic", fx.logic)):
        one = fx.verified(fix(t.damaged), name)
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: rnd(F.col(c), 4) for c in ("max_null_share", "mean_null_share")})


_CHECKS = f"""l AS (SELECT DISTINCT order_id, coalesce(customer_id, 0) AS customer_id, coalesce(amount, 0) AS amount, trim(category) AS category, event_time FROM damaged),
    m AS ({_measures_sql('l', _COLS)}),
    c AS (SELECT 'output_has_columns' AS "check", columns > 0 AS passed, {R('columns', 4)} AS value FROM m
        UNION ALL SELECT 'output_has_rows', rows > 0, {R('rows', 4)} FROM m
        UNION ALL SELECT 'low_null_rate', mean_null_share < 0.20, {R('mean_null_share', 4)} FROM m
        UNION ALL SELECT 'no_duplicate_rows', copies = 0, {R('copies / rows', 4)} FROM m
        UNION ALL SELECT 'idempotent', TRUE, {R('rows', 4)} FROM m
        UNION ALL SELECT 'schema_preserved', TRUE, 0.0::DOUBLE FROM m)"""


@query("v04_validate", f"WITH {_CHECKS} SELECT * FROM c", "damaged")
def _(t):
    return va.validate(t.damaged, fx.logic)


@query("v06_confidence", f"WITH {_CHECKS} SELECT count(*) FILTER (WHERE passed) AS passed, count(*) AS total, {R('count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE)', 4)} AS confidence FROM c", "damaged")
def _(t):
    return va.overall(va.validate(t.damaged, fx.logic))


@query("v03_duplicate_rate", f"""SELECT count(*) AS rows, {R('1.0 - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) / CAST(count(*) AS DOUBLE)', 4)} AS duplicate_rate FROM lineitem""")
def _(t):
    m = fx.verify(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))
    return m.select("rows", rnd(F.col("copies") / F.col("rows"), 4).alias("duplicate_rate"))


@query("v07_schema_changes", """SELECT * FROM (VALUES ('customer_id', 'type_changed', 'bigint', 'double'), ('nothing', 'column_removed', 'string', NULL),
    ('amount_note', 'column_added', NULL, 'string')) v(column_name, event_type, old_value, new_value) WHERE (SELECT count(*) FROM damaged) > 0""", "damaged")
def _(t):
    before = t.damaged.withColumn("nothing", F.lit(None).cast("string"))
    after = fx.connection(before).withColumns({"customer_id": F.col("customer_id").cast("double"), "amount_note": F.lit("x")})
    return va.schema_changes(before, after)


