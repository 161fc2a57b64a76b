"""Queries: profiling, rules, drift and personal-data columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.constants import PII_PATTERNS
from tidemill.operators import profile_store as ps
from tidemill.operators import quality as q
from tidemill.plans.oracle import AS_OF, D, R, lit
from tidemill.plans.registry import query
from tidemill.session import scratch_path


def _profile_sql(table: str, columns: dict[str, str], source: str | None = None) -> str:
    parts = []
    for c, kind in columns.items():
        if kind == "s":
            bounds = "NULL::VARCHAR AS min_value, NULL::VARCHAR AS max_value"
        else:
            cast = {"d": "CAST({} AS DECIMAL(38,6))", "i": "{}", "t": "{}"}[kind]
            bounds = ", ".join(f"CAST({cast.format(f'{f}({c})')} AS VARCHAR) AS {f}_value" for f in ("min", "max"))
        parts.append(f"""SELECT {lit(table)} AS table_name, count(*) AS row_count, {lit(c)} AS column_name,
            {R(f'100.0::DOUBLE * (count(*) - count({c})) / nullif(count(*), 0)', 1)} AS null_pct,
            count(DISTINCT {c}) AS distinct_count, {bounds} FROM {source or table}""")
    return " UNION ALL ".join(parts)


_DAMAGED_COLS = {"order_id": "i", "customer_id": "i", "amount": "d", "category": "s", "event_time": "t"}
_EVENT_COLS = {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "d", "props": "s"}


@query("q01_profile_damaged", _profile_sql("damaged", _DAMAGED_COLS), "damaged")
def _(t):
    return q.profile(t.damaged, "damaged")


@query("q01_profile_events", _profile_sql("events", _EVENT_COLS))
def _(t):
    return q.profile(t.events, "events")


@query("q01_profile_approx")
def _(t):
    return q.profile(t.lineitem, "lineitem", approx_distinct=True)


_STORED = {"event_id": "i", "user_id": "i", "event_type": "s", "value": "d", "ts": "t"}


@query("q01_profile_stored", " UNION ALL ".join(f"""SELECT {lit(c)} AS column_name, count(*) AS row_count,
    {R(f'100.0::DOUBLE * (count(*) - count({c})) / nullif(count(*), 0)', 1)} AS null_pct, count(DISTINCT {c}) AS distinct_count,
    true AS distinct_close, {'true' if kind in 'id' else 'NULL::BOOLEAN'} AS median_close FROM events""" for c, kind in _STORED.items()))
def _(t):
    # Two deliveries of several files; the second profile reads the second one only.
    events = t.events.select(*_STORED)
    path, store = scratch_path(t.spark, "events"), scratch_path(t.spark, "sketches")
    for half in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        events.filter(half).repartition(3).write.mode("append").parquet(path)
        ps.refresh(t.spark, path, store)
    kept = ps.merged(t.spark.read.parquet(store))
    numbers = [c for c, kind in _STORED.items() if kind in "id"]
    middle = kept.filter(F.col("column_name").isin(numbers)).groupBy().pivot("column_name", numbers).agg(F.first("median"))
    # The exact values, in one aggregate; the medians are one row.
    exact = events.crossJoin(F.broadcast(middle.select(*[F.col(c).alias(f"_{c}") for c in numbers]))).agg(
        *[F.count_distinct(c).alias(f"d_{c}") for c in _STORED],
        *[(F.count_if(F.col(c) <= F.col(f"_{c}")) / F.count(c)).alias(f"r_{c}") for c in numbers])
    facts = exact.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("exact"),
        (F.col(f"r_{c}") if c in numbers else F.lit(None).cast("double")).alias("rank")) for c in _STORED])))
    return kept.join(facts, "column_name").select(
        "column_name", "row_count", "null_pct", F.col("exact").alias("distinct_count"),
        (F.abs(F.col("distinct_count") / F.col("exact") - 1) <= 0.05).alias("distinct_close"),
        F.col("rank").between(0.46, 0.54).alias("median_close"))


@query("q02_health_score", f"""SELECT table_name, CAST(greatest(0, 100 - CAST(floor({R('avg(null_pct) * 2', 6)}) AS INTEGER)) AS INTEGER) AS health_score
    FROM ({_profile_sql('damaged', _DAMAGED_COLS)} UNION ALL {_profile_sql('events', _EVENT_COLS)}) GROUP BY 1""", "damaged")
def _(t):
    return q.health_score(q.profile(t.damaged, "damaged").unionByName(q.profile(t.events, "events")))


def _first_sql(name: str, source: str, column: str) -> str:
    share = R(f"100.0::DOUBLE * (count(*) - count({column})) / nullif(count(*), 0)", 1)
    return f"""SELECT {lit(name)} AS table_name, count(*) AS row_count,
        CAST(greatest(0, 100 - floor(coalesce({share}, 0.0) * 2)) AS INTEGER) AS health_score FROM {source}"""


@query("q03_first_column_health", f"""SELECT *, CASE WHEN health_score >= 80 THEN 'healthy' WHEN health_score >= 50 THEN 'warning' ELSE 'critical' END AS health
    FROM ({_first_sql('orders', 'orders', 'o_orderkey')} UNION ALL {_first_sql('by_category', 'damaged', 'category')}
          UNION ALL {_first_sql('by_amount', 'damaged', 'amount')})""", "damaged")
def _(t):
    return q.first_column_health({
        "orders": t.orders, "by_category": t.damaged.select("category"), "by_amount": t.damaged.select("amount")})


RULES = [
    q.Rule("amount_present", "damaged", "not_null", "amount", 5.0),
    q.Rule("category_present", "damaged", "not_null", "category", 60.0),
    q.Rule("order_unique", "damaged", "uniqueness", "order_id", 1.0),
    q.Rule("customer_unique", "damaged", "uniqueness", "customer_id", 100.0),
    q.Rule("enough_rows", "damaged", "row_count", threshold=100),
    q.Rule("fresh", "events", "freshness", "ts", 24.0),
    q.Rule("fresh_orders", "orders", "freshness", "o_orderdate", 24.0),
    q.Rule("price_range", "orders", "range", "o_totalprice", low=0.0, high=100000.0),
    q.Rule("priority_form", "orders", "regex", "o_orderpriority", pattern="^[1-5]-[A-Z ]+$"),
    q.Rule("type_form", "events", "regex", "event_type", pattern="^(view|click)$"),
    q.Rule("customer_known", "orders", "referential", "o_custkey", ref_table="rich_customers", ref_column="c_custkey"),
    q.Rule("has_orders", "orders", "custom_sql", sql="SELECT count(*) > 0 FROM orders"),
    q.Rule("off", "orders", "row_count", threshold=1e12, enabled=False),
]


def _rule_sql(r: q.Rule) -> str:
    n, c, zero = "count(*)", r.column, "CAST(0 AS BIGINT)"
    source = r.table
    if r.kind == "not_null":
        bad = f"(count(*) - count({c}))"
        metric, failed = f"100.0::DOUBLE * {bad} / {n}", f"100.0::DOUBLE * {bad} / {n} > {r.threshold}"
    elif r.kind == "uniqueness":
        bad = f"(count(*) - count(DISTINCT {c}))"
        metric, failed = f"100.0::DOUBLE * {bad} / {n}", f"100.0::DOUBLE * {bad} / {n} > {r.threshold}"
    elif r.kind == "row_count":
        bad, metric, failed = zero, D(n), f"{n} < {r.threshold}"
    elif r.kind == "freshness":
        metric = f"(epoch_us({AS_OF}) - epoch_us(max({c}))) / 3.6e9::DOUBLE"
        bad, failed = zero, f"{metric} > {r.threshold}"
    elif r.kind == "range":
        bad = f"count(*) FILTER (WHERE NOT {c} BETWEEN {r.low} AND {r.high})"
        metric, failed = D(bad), f"{bad} > 0"
    elif r.kind == "regex":
        bad = f"count(*) FILTER (WHERE NOT regexp_matches({c}, {lit(r.pattern)}))"
        metric, failed = D(bad), f"{bad} > 0"
    elif r.kind == "referential":
        bad = f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))"
        metric, failed = D(bad), f"{bad} > 0"
    else:
        bad, metric, failed = zero, f"CASE WHEN {n} > 0 THEN 1.0 ELSE 0.0 END", f"NOT {n} > 0"
    low, high = (R(f"CAST({f}({c}) AS DOUBLE)", 4) if r.kind == "range" else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
    values = f"', values ' || CAST(CAST({low} AS DECIMAL(30,4)) AS VARCHAR) || ' to ' || CAST(CAST({high} AS DECIMAL(30,4)) AS VARCHAR)"
    message = f"""{lit(r.kind + (' of ' + c if c else '') + ': ')} || coalesce(CAST(CAST({R(metric, 4)} AS DECIMAL(30,4)) AS VARCHAR), 'no value')
        || ', threshold {r.threshold:.4f}' || coalesce({values}, '')"""
    return f"""SELECT {n} AS row_count, {lit(r.rule_id)} AS rule_id, {lit(r.table)} AS table_name, {lit(r.kind)} AS kind,
        CASE WHEN {failed} THEN 'fail' ELSE 'pass' END AS status, {R(metric, 4)} AS metric,
        {float(r.threshold)}::DOUBLE AS threshold, {bad} AS error_rows, {low} AS min_value, {high} AS max_value,
        {message} AS message FROM {source}"""


def _rule_tables(t):
    return {"damaged": t.damaged, "orders": t.orders, "events": t.events, "rich_customers": t.customer.filter("c_acctbal > 0")}


def _register_rule_kinds():
    names = {"not_null": "q04_rule_not_null", "uniqueness": "q05_rule_uniqueness", "row_count": "q06_rule_row_count",
             "freshness": "q07_rule_freshness", "range": "q08_rule_range", "custom_sql": "q09_rule_custom_sql",
             "regex": "q10_rule_regex", "referential": "q11_rule_referential"}
    for kind, name in names.items():
        rules = [r for r in RULES if r.kind == kind and r.enabled]

        @query(name, " UNION ALL ".join(_rule_sql(r) for r in rules), "damaged")
        def _(t, rules=rules):
            return q.run_rules(_rule_tables(t), rules, t.as_of)


_register_rule_kinds()
_ALL_RULES = " UNION ALL ".join(_rule_sql(r) for r in RULES if r.enabled)


@query("q12_rule_set", _ALL_RULES, "damaged")
def _(t):
    return q.run_rules(_rule_tables(t), RULES, t.as_of)


def _snapshots(t):
    """Two snapshots of the data catalog: columns leave when the balance is high and arrive when it is negative."""
    base = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment").withColumnRenamed("c_custkey", "key")
    cat = base.join(t.catalog.withColumn("key", F.col("ordinal") + 24 * F.regexp_extract("table_name", r"(\d+)", 1).cast("bigint")), "key")
    old = cat.filter("c_acctbal >= 0").select("table_name", "column_name", "data_type", F.lit(True).alias("nullable"))
    new = cat.filter("c_acctbal < 5000").select(
        "table_name", "column_name",
        F.when(F.col("c_mktsegment") == "BUILDING", "text").otherwise(F.col("data_type")).alias("data_type"),
        (F.col("c_mktsegment") != "MACHINERY").alias("nullable"))
    return old, new


_DRIFT_SQL = """
    cat AS (SELECT table_name, column_name, data_type, c_acctbal, c_mktsegment FROM catalog
            JOIN customer ON c_custkey = ordinal + 24 * CAST(regexp_extract(table_name, '(\\d+)', 1) AS BIGINT)),
    o AS (SELECT table_name, column_name, data_type, TRUE AS nullable FROM cat WHERE c_acctbal >= 0),
    n AS (SELECT table_name, column_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'text' ELSE data_type END AS data_type,
                 c_mktsegment <> 'MACHINERY' AS nullable FROM cat WHERE c_acctbal < 5000),
    ot AS (SELECT DISTINCT table_name FROM o), nt AS (SELECT DISTINCT table_name FROM n),
    j AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.column_name, n.column_name) AS column_name,
            o.data_type AS old_type, n.data_type AS new_type, o.nullable AS old_nullable, n.nullable AS new_nullable,
            CASE WHEN o.table_name IS NULL THEN 'column_added' WHEN n.table_name IS NULL THEN 'column_removed'
                 WHEN o.data_type <> n.data_type THEN 'type_changed' WHEN o.nullable <> n.nullable THEN 'constraint_changed' END AS event_type
          FROM o FULL OUTER JOIN n ON o.table_name = n.table_name AND o.column_name = n.column_name),
    drift AS (SELECT table_name, NULL::VARCHAR AS column_name, 'table_removed' AS event_type, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value
              FROM ot WHERE table_name NOT IN (SELECT table_name FROM nt)
        UNION ALL SELECT table_name, NULL, 'table_added', NULL, NULL FROM nt WHERE table_name NOT IN (SELECT table_name FROM ot)
        UNION ALL SELECT table_name, column_name, event_type,
            CASE WHEN event_type = 'constraint_changed' THEN CAST(old_nullable AS VARCHAR) ELSE old_type END,
            CASE WHEN event_type = 'constraint_changed' THEN CAST(new_nullable AS VARCHAR) ELSE new_type END
        FROM j WHERE event_type IS NOT NULL AND table_name IN (SELECT table_name FROM ot) AND table_name IN (SELECT table_name FROM nt))"""


@query("q13_quality_summary", f"""WITH {_DRIFT_SQL}, res AS ({_ALL_RULES}), f AS (SELECT count(*) FILTER (WHERE status = 'fail') AS failing FROM res)
    SELECT 4 AS tables, {sum(r.enabled for r in RULES)} AS enabled_rules, failing, (SELECT count(*) FROM drift) AS open_drift,
           CASE WHEN failing = 0 THEN 'good' WHEN failing < 3 THEN 'warning' ELSE 'critical' END AS overall FROM f""", "damaged catalog")
def _(t):
    results = q.run_rules(_rule_tables(t), RULES, t.as_of)
    return q.quality_summary(4, results, RULES, q.schema_drift(*_snapshots(t)))


@query("q14_schema_snapshot", "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS row_count, * FROM " + """(VALUES
    (1, 'o_orderkey', 'bigint', TRUE), (2, 'o_custkey', 'bigint', TRUE), (3, 'o_orderstatus', 'string', TRUE),
    (4, 'o_totalprice', 'double', TRUE), (5, 'o_orderdate', 'timestamp_ntz', TRUE), (6, 'o_orderpriority', 'string', TRUE))
    v(ordinal, column_name, data_type, nullable)""")
def _(t):
    return q.schema_snapshot(t.orders, "orders")


@query("q15_schema_drift", f"WITH {_DRIFT_SQL} SELECT * FROM drift", "catalog")
def _(t):
    return q.schema_drift(*_snapshots(t))


def _load_check_sql(table: str, columns) -> str:
    return " UNION ALL ".join(f"""SELECT 'damaged' AS table_name, {lit(c)} AS column_name, 'warning' AS level,
        {R(f'100.0::DOUBLE * (count(*) - count({c})) / count(*)', 1)} AS null_pct FROM {table}
        HAVING 1.0::DOUBLE * (count(*) - count({c})) / count(*) > 0.10""" for c in columns)


@query("q16_load_check", _load_check_sql("damaged", _DAMAGED_COLS) + """ UNION ALL SELECT 'empty', NULL, 'error', NULL
    FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0""", "damaged")
def _(t):
    empty = t.orders.filter(F.col("o_totalprice") < 0)
    return q.load_check(t.damaged, "damaged").unionByName(q.load_check(empty, "empty"))


def _pii_case(index: int) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(column_name), {lit(p[0])}) THEN {lit(p[index])}" for p in PII_PATTERNS)
    return f"CASE {whens} END"


_PII = f"""pii AS (SELECT *, 0.95::DOUBLE AS confidence FROM (SELECT *, {_pii_case(1)} AS pii_type, {_pii_case(2)} AS severity FROM catalog)
    WHERE pii_type IS NOT NULL)"""


@query("q17_pii_columns", f"WITH {_PII} SELECT * FROM pii", "catalog")
def _(t):
    return q.classify_pii(t.catalog)


@query("q18_pii_rollup", f"""WITH {_PII} SELECT table_name, count(*) AS total, count(*) FILTER (WHERE severity = 'high' AND data_type <> 'text') AS high,
    count(*) FILTER (WHERE severity = 'medium' AND data_type <> 'text') AS medium, count(*) FILTER (WHERE severity = 'low' AND data_type <> 'text') AS low
    FROM pii GROUP BY 1""", "catalog")
def _(t):
    found = q.classify_pii(t.catalog).withColumn("suppressed", F.col("data_type") == "text")
    return q.pii_rollup(found)


@query("q19_pii_suppress", f"""WITH {_PII} SELECT table_name, column_name, severity, column_name IN (SELECT column_name FROM catalog_notes) AS suppressed FROM pii""",
       "catalog catalog_notes")
def _(t):
    found = q.classify_pii(t.catalog).select("table_name", "column_name", "severity").withColumn("suppressed", F.lit(False))
    return q.suppress_findings(found, t.catalog_notes, ["column_name"])
