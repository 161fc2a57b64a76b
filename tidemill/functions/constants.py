"""Thresholds, vocabularies and lookup tables that results depend on."""

# Detection thresholds.
ROW_DROP_SHARE = 0.20
NULL_SPIKE_SHARE = 0.10
NULL_BASELINE_SHARE = 0.02
DUPLICATE_SPIKE_SHARE = 0.05
DELAY_FACTOR = 2.0
SLA_FACTOR = 3.0
MIN_CONSECUTIVE_FAILURES = 2
CDC_LAG_SECONDS = 300
SKEW_RATIO = 5.0
CHECKPOINT_SECONDS = 120
MICRO_BATCH_SECONDS = 60
BACKLOG_ROWS = 100_000
CASCADE_PIPELINES = 3
DEFAULT_SLA_SECONDS = 3600

# Target seconds per pipeline.
SLA_SECONDS = {
    "ingest_nyc_taxi": 1800,
    "ingest_ecommerce": 900,
    "dbt_run": 3600,
    "kafka_consumer": 300,
    "flink_job": 60,
    "spark_streaming": 30,
}

# Error text signature -> anomaly type, first match wins.
ERROR_SIGNATURES = [
    ("could not connect to server", "ZERO_LOAD"),
    ("ssl connection has been closed", "ZERO_LOAD"),
    ("connection refused", "ZERO_LOAD"),
    ("too many connections", "RATE_LIMIT_HIT"),
    ("canceling statement due to conflict", "PIPELINE_DELAY"),
    ("deadlock detected", "CONSECUTIVE_FAILURES"),
    ("out of shared memory", "PIPELINE_DELAY"),
    ("duplicate key value violates", "DUPLICATE_SPIKE"),
    ("query result expired", "PIPELINE_DELAY"),
    ("warehouse suspended", "RATE_LIMIT_HIT"),
    ("account does not have enough credits", "RATE_LIMIT_HIT"),
    ("stream has become stale", "CDC_LAG"),
    ("query exceeded memory limit", "PIPELINE_DELAY"),
    ("schema evolution", "SCHEMA_DRIFT"),
    ("quota exceeded", "RATE_LIMIT_HIT"),
    ("not found: dataset", "ZERO_LOAD"),
    ("resources exceeded during query", "PIPELINE_DELAY"),
    ("streaming buffer not available", "CDC_LAG"),
    ("schema mismatch", "SCHEMA_DRIFT"),
    ("max_allowed_packet", "PIPELINE_DELAY"),
    ("lock wait timeout exceeded", "CONSECUTIVE_FAILURES"),
    ("table is full", "RATE_LIMIT_HIT"),
    ("binlog format is not row", "CDC_LAG"),
    ("cursor id not found", "PIPELINE_DELAY"),
    ("oplog is too small", "CDC_LAG"),
    ("changestream cursor timeout", "CDC_LAG"),
    ("write conflict", "CONSECUTIVE_FAILURES"),
    ("stl_load_errors", "DATA_TYPE_MISMATCH"),
    ("permission denied for relation", "ZERO_LOAD"),
    ("disk full", "RATE_LIMIT_HIT"),
    ("catalog error", "SCHEMA_DRIFT"),
    ("out of memory error", "PIPELINE_DELAY"),
    ("offset out of range", "CHECKPOINT_FAILURE"),
    ("consumer group rebalance", "INCREMENTAL_SYNC_FAILURE"),
    ("transaction marker", "DATA_TYPE_MISMATCH"),
    ("job manager lost", "ZERO_LOAD"),
    ("task manager heartbeat timeout", "ZERO_LOAD"),
    ("checkpoint failed", "CHECKPOINT_FAILURE"),
    ("checkpoint timeout exceeded", "CHECKPOINT_FAILURE"),
    ("state backend restore failed", "CHECKPOINT_FAILURE"),
    ("savepoint could not be created", "CHECKPOINT_FAILURE"),
    ("back pressure", "PIPELINE_DELAY"),
    ("watermark stalled", "CDC_LAG"),
    ("late arriving event", "CDC_LAG"),
    ("operator chaining failed", "CONSECUTIVE_FAILURES"),
    ("job vertex failed", "CONSECUTIVE_FAILURES"),
    ("rocksdb compaction error", "PIPELINE_DELAY"),
    ("stream query terminated with exception", "CONSECUTIVE_FAILURES"),
    ("micro-batch processing time exceeded", "PIPELINE_DELAY"),
    ("offset does not exist", "CHECKPOINT_FAILURE"),
    ("streaming query stopped", "ZERO_LOAD"),
    ("state store key not found", "INCREMENTAL_SYNC_FAILURE"),
    ("trigger interval exceeded", "PIPELINE_DELAY"),
    ("executor lost", "CONSECUTIVE_FAILURES"),
    ("driver crashed", "ZERO_LOAD"),
    ("shuffle fetch failed", "PIPELINE_DELAY"),
    ("connection timed out", "ZERO_LOAD"),
    ("read timeout", "PIPELINE_DELAY"),
    ("ssl: wrong version number", "ZERO_LOAD"),
    ("incremental load", "INCREMENTAL_SYNC_FAILURE"),
]
# Two signatures above hold upper case in their original form ("SSL connection has been
# closed") and so never match lower-cased text there; we match them, as intended.

# Words that mark a failed run as a schema problem, in test order.
DRIFT_KEYWORDS = [
    "column", "schema", "does not exist", "no attribute", "unexpected field", "schema evolution",
    "schema mismatch", "extra field", "missing field", "type mismatch", "cast failed",
]

# Anomaly vocabulary.
ANOMALY_TYPES = [
    "ZERO_LOAD", "ROW_COUNT_DROP", "NULL_SPIKE", "PIPELINE_DELAY", "CONSECUTIVE_FAILURES",
    "SCHEMA_DRIFT", "CDC_LAG", "RATE_LIMIT_HIT", "INCREMENTAL_SYNC_FAILURE", "CASCADING_FAILURE",
    "DUPLICATE_SPIKE", "SLA_BREACH", "CHECKPOINT_FAILURE", "DATA_TYPE_MISMATCH", "PARTITION_SKEW",
]

# Anomaly type -> category.
ANOMALY_CATEGORY = {
    "ZERO_LOAD": "data_freshness",
    "ROW_COUNT_DROP": "data_freshness",
    "INCREMENTAL_SYNC_FAILURE": "data_freshness",
    "CDC_LAG": "data_freshness",
    "NULL_SPIKE": "data_quality",
    "DUPLICATE_SPIKE": "data_quality",
    "DATA_TYPE_MISMATCH": "data_quality",
    "SCHEMA_DRIFT": "data_quality",
    "PIPELINE_DELAY": "infrastructure",
    "SLA_BREACH": "infrastructure",
    "RATE_LIMIT_HIT": "infrastructure",
    "CASCADING_FAILURE": "infrastructure",
    "CONSECUTIVE_FAILURES": "reliability",
    "CHECKPOINT_FAILURE": "reliability",
    "PARTITION_SKEW": "reliability",
}

# Anomaly type -> (root cause text, confidence, fix type, urgency).
DIAGNOSES = {
    "ZERO_LOAD": ("Pipeline '{pipeline}' loaded zero records — source connectivity failure, empty upstream dataset, or auth token expired.", 0.80, "connection", "critical"),
    "ROW_COUNT_DROP": ("Record count dropped {metric}% vs 7-day avg — upstream data volume reduction, partial pipeline failure, or source filter regression.", 0.70, "volume", "high"),
    "NULL_SPIKE": ("Null rate exceeded 10% threshold — schema drift upstream (new nullable column or renamed field) or data quality regression in source system.", 0.75, "schema_change", "high"),
    "PIPELINE_DELAY": ("Pipeline duration exceeded 2x normal — resource contention, inefficient query, or upstream data volume surge causing GC pressure.", 0.65, "timeout", "medium"),
    "CONSECUTIVE_FAILURES": ("Pipeline '{pipeline}' failed {metric} times consecutively — persistent error in DAG logic, broken connection, or infrastructure issue.", 0.80, "logic", "critical"),
    "SCHEMA_DRIFT": ("Schema change detected in pipeline '{pipeline}' — upstream source added/removed/renamed a column or changed a data type without coordinated migration.", 0.85, "schema_change", "critical"),
    "CDC_LAG": ("CDC consumer lag exceeded {metric}s — Debezium connector stalled, Kafka consumer group rebalancing, or oplog/binlog window expired.", 0.80, "cdc_lag", "high"),
    "RATE_LIMIT_HIT": ("API or warehouse rate limit hit — Snowflake credits exhausted, BigQuery quota exceeded, or source API throttling concurrent requests.", 0.85, "rate_limit", "high"),
    "INCREMENTAL_SYNC_FAILURE": ("Incremental sync watermark failure — checkpoint state lost, late-arriving events after watermark cutoff, or deduplication key collision.", 0.75, "incremental_sync", "high"),
    "CASCADING_FAILURE": ("Multiple pipelines failing simultaneously ({metric} pipelines) — shared infrastructure failure (DB, network, IAM), or upstream data source outage.", 0.90, "cascading", "critical"),
    "DUPLICATE_SPIKE": ("Duplicate record rate spiked — upstream system replaying events, CDC at-least-once delivery without idempotent sink, or deduplication logic removed.", 0.70, "data_quality", "high"),
    "SLA_BREACH": ("Pipeline exceeded SLA by {metric}x — data volume surge, resource starvation, or query plan regression.", 0.70, "timeout", "high"),
    "CHECKPOINT_FAILURE": ("Stream checkpoint corrupted or reset — Kafka offset out of range after topic compaction, or checkpoint storage inaccessible.", 0.80, "checkpoint", "critical"),
    "DATA_TYPE_MISMATCH": ("Data type mismatch between source and target schema — source changed numeric to string, or added precision to a float/decimal column.", 0.80, "schema_change", "high"),
}
DIAGNOSIS_DEFAULT = ("Anomaly type '{type}' detected — manual investigation required.", 0.30, "manual_review", "medium")

# Anomaly type -> confidence boost.
CONFIDENCE_BOOST = {
    "ZERO_LOAD": 0.15,
    "CONSECUTIVE_FAILURES": 0.10,
    "SCHEMA_DRIFT": 0.20,
    "CDC_LAG": 0.15,
    "RATE_LIMIT_HIT": 0.20,
    "CASCADING_FAILURE": 0.25,
    "INCREMENTAL_SYNC_FAILURE": 0.15,
    "DUPLICATE_SPIKE": 0.10,
    "SLA_BREACH": 0.10,
    "CHECKPOINT_FAILURE": 0.20,
}

# Anomaly type -> remediation name.
REMEDIATION_FOR = {
    "ZERO_LOAD": "connection",
    "ROW_COUNT_DROP": "volume",
    "NULL_SPIKE": "schema_change",
    "PIPELINE_DELAY": "timeout",
    "SLA_BREACH": "timeout",
    "CONSECUTIVE_FAILURES": "logic",
    "SCHEMA_DRIFT": "schema_change",
    "CDC_LAG": "cdc_lag",
    "RATE_LIMIT_HIT": "rate_limit",
    "INCREMENTAL_SYNC_FAILURE": "incremental_sync",
    "CASCADING_FAILURE": "cascading",
    "DUPLICATE_SPIKE": "duplicate_spike",
    "CHECKPOINT_FAILURE": "checkpoint",
    "DATA_TYPE_MISMATCH": "schema_change",
    "PARTITION_SKEW": "partition_skew",
    "ML_ANOMALY": "data_quality",
}

# Root-cause words -> remediation, tried in order when the type is not listed above.
REMEDIATION_KEYWORDS = [
    (["snowflake", "variant", "flatten"], "snowflake_schema"),
    (["bigquery", "bq", "slot"], "bigquery_type"),
    (["mysql", "binlog", "rds"], "mysql_cdc"),
    (["mongo", "objectid", "document"], "mongodb_flatten"),
    (["redshift", "stl_load", "varchar"], "redshift_load"),
    (["partition", "skew", "hot partition"], "partition_skew"),
    (["cdc", "debezium", "binlog", "oplog"], "cdc_lag"),
    (["schema", "column", "drift", "type mismatch"], "schema_change"),
    (["null", "quality", "duplicate"], "data_quality"),
    (["connect", "timeout", "ssl"], "connection"),
    (["zero", "empty", "volume"], "volume"),
]

# Column-name pattern -> (kind of personal data, severity), first match wins.
PII_PATTERNS = [
    (r"\bemail\b", "Email Address", "high"),
    (r"\bphone(_number)?\b", "Phone Number", "high"),
    (r"\bssn\b|social_security", "Social Security #", "high"),
    (r"\bcredit_card\b|card_number\b", "Credit Card", "high"),
    (r"\bpassword\b|passwd\b|pwd\b", "Password/Secret", "high"),
    (r"\bapi_key\b|secret_key\b|access_token", "API Key/Secret", "high"),
    (r"\bip_address\b|ip_addr\b", "IP Address", "medium"),
    (r"\bfirst_name\b|last_name\b|full_name\b|display_name\b", "Full Name", "medium"),
    (r"\baddress\b|street\b|zip(_code)?\b", "Physical Address", "medium"),
    (r"\bdob\b|date_of_birth\b|birth_date\b", "Date of Birth", "high"),
    (r"\bgender\b|sex\b", "Gender", "low"),
    (r"\brace\b|ethnicity\b", "Race/Ethnicity", "high"),
    (r"\bsalary\b|income\b|wage\b", "Financial Data", "medium"),
    (r"\bpassport\b|driver_license\b|dl_number\b", "Gov ID", "high"),
    (r"\blatitude\b|longitude\b|geo_point\b", "Geolocation", "medium"),
    (r"\buser_agent\b|device_id\b", "Device ID", "low"),
    (r"\bmedical\b|diagnosis\b|prescription\b", "Medical Data", "high"),
    (r"\bnational_id\b|tax_id\b|vat_number\b", "Tax/National ID", "high"),
]

# SQL anti-patterns (name, regex, severity, cost impact %).
ANTI_PATTERNS = [
    ("SELECT_STAR", r"\bSELECT\s+\*", "high", 30),
    ("NO_LIMIT", r"^(?![\s\S]*\bLIMIT\b)[\s\S]*\bFROM\b", "high", 20),
    ("CORRELATED_SUBQUERY", r"\bIN\s*\(\s*SELECT\b|\bNOT\s+IN\s*\(\s*SELECT\b|\bEXISTS\s*\(\s*SELECT\b", "high", 50),
    ("CARTESIAN_JOIN", r"\bFROM\b[\s\S]{1,300}(?<!\bJOIN\b)\s+\w[\w.]*\s*,\s*\w[\w.]*", "critical", 90),
    ("FULL_TABLE_SCAN", r"\bFROM\s+[\w.]+\s*(?:$|\s+ORDER|\s+GROUP|\s+HAVING|\s+UNION|;)", "high", 40),
    ("FUNCTION_ON_INDEXED_COL", r"(?:WHERE|AND|OR)\s+\w+\((\w+)\)", "medium", 35),
    ("DISTINCT_ON_GROUP_BY", r"\bSELECT\s+DISTINCT\b[\s\S]*\bGROUP\s+BY\b", "low", 5),
    ("OR_IN_WHERE", r"\bWHERE\b[\s\S]*\bOR\b", "medium", 25),
    ("LIKE_LEADING_WILDCARD", r"\bLIKE\s+'%", "medium", 30),
    ("SUBQUERY_IN_SELECT", r"SELECT\s+[^,\n]+\(\s*SELECT\b", "high", 45),
    ("SNOWFLAKE_NO_CLUSTERING", r"\bFROM\s+\w+\b(?![\s\S]*\bCLUSTER\s+BY\b)", "medium", 20),
    ("SNOWFLAKE_NON_RESULT_CACHE", r"CURRENT_TIMESTAMP\b|NOW\(\)", "low", 10),
    ("BQ_NO_PARTITION_FILTER", r"FROM\s+`[\w.\-]+`(?![\s\S]*\bWHERE\b[\s\S]*(?:_PARTITIONDATE|partition_date|event_date))", "critical", 80),
    ("BQ_SELECT_EXCEPT", r"\bSELECT\s+\*\s+EXCEPT\b", "medium", 15),
    ("REDSHIFT_NO_SORTKEY", r"\bORDER\s+BY\b(?![\s\S]*\bSORT\s+KEY\b)", "medium", 20),
    ("REDSHIFT_LEADER_ONLY", r"\bSYS[VT]_|STL_|SVV_|PG_", "low", 5),
    ("MYSQL_IMPLICIT_CONVERSION", r"WHERE\s+\w+\s*=\s*['\"][\d]+['\"]", "medium", 25),
    ("DUCKDB_NO_PARQUET_FILTER_PUSHDOWN", r"read_csv\(|read_parquet\(", "medium", 20),
]

# Anti-patterns that apply to one dialect only.
DIALECT_ONLY = {
    "SNOWFLAKE_NO_CLUSTERING": "snowflake",
    "SNOWFLAKE_NON_RESULT_CACHE": "snowflake",
    "BQ_NO_PARTITION_FILTER": "bigquery",
    "BQ_SELECT_EXCEPT": "bigquery",
    "REDSHIFT_NO_SORTKEY": "redshift",
}

# Price model of the savings estimate.
SNOWFLAKE_CREDIT_PRICE = 2.5
BIGQUERY_TB_PRICE = 5.0

# Words that make a statement a write, per caller.
WRITE_WORDS = ["DROP", "DELETE", "TRUNCATE", "ALTER", "UPDATE", "INSERT", "GRANT", "REVOKE"]
WRITE_WORDS_ANALYST = ["DROP", "DELETE", "TRUNCATE", "ALTER", "UPDATE", "INSERT", "GRANT", "REVOKE", "CREATE", "REPLACE", "MERGE", "CALL"]
WRITE_WORDS_OPTIMIZER = ["DROP", "DELETE", "TRUNCATE", "ALTER", "INSERT", "UPDATE", "CREATE", "GRANT", "REVOKE"]
WRITE_WORDS_RULES = ["DROP", "DELETE", "TRUNCATE", "ALTER", "UPDATE", "INSERT", "CREATE", "GRANT", "REVOKE", "COPY", "CALL", "DO"]

# Weights of the heuristic cost score.
COST_BASE = 500
COST_FLOOR = 100
COST_WEIGHTS = [
    (r"\bSELECT\s+\*", True, 500),
    (r"\bLIMIT\b", False, 800),
    (r"FROM\s+\w+[\w.]*\s*,\s*\w+", True, 2000),
    (r"WHERE\s+\w+\s+IN\s*\(SELECT", True, 1500),
    (r"\bJOIN\b", True, 300),
    (r"\bGROUP BY\b", True, 200),
    (r"\bORDER BY\b", True, 150),
    (r"\bWHERE\b", True, -200),
    (r"\bLIMIT\b", True, -400),
]
CREDITS_PER_COST_UNIT = 0.001

# Airport zones.
AIRPORT_ZONES = [1, 132, 138]

# Default alert rules (name, condition, channel, threshold, cooldown minutes, enabled).
ALERT_RULES = [
    ("Pipeline Failure Alert", "pipeline_failure", "slack", 0.0, 60, True),
    ("Anomaly Detected", "anomaly", "slack", 0.8, 120, True),
    ("Null Spike Alert", "null_spike", "slack", 20.0, 60, True),
    ("Row Count Drop", "row_count_drop", "slack", 30.0, 30, False),
    ("SLA Breach", "sla_breach", "pagerduty", 0.0, 30, True),
    ("Cost Threshold Exceeded", "cost_threshold", "email", 50.0, 1440, False),
]

# Insight rows (title, insight, severity, metric, time window, table); {..} are measured values.
# The severity "by_airport_share" is opportunity above 10 % airport trips, else info.
INSIGHTS = [
    ("NYC Taxi generated ${rev} in 7-day revenue", "The last 7 days saw {trips} trips with ${rev} in total fare revenue. Average fare per trip is ${fare}.", "info", "${rev} revenue", "7d", "marts.fct_trips"),
    ("{apt}% of taxi trips are airport-related", "Airport trips (JFK, LGA, EWR) represent {apt}% of all trips. These typically command higher fares.", "by_airport_share", "{apt}% airport", "7d", "marts.fct_trips"),
    ("E-commerce revenue: ${eco_rev} last 7 days", "{eco_ord} orders totalling ${eco_rev} were placed in the last 7 days.", "info", "${eco_rev}", "7d", "marts.fct_ecommerce_summary"),
    ("{vip} VIP customers identified", "{vip} customers have spent >$1,000 lifetime and are classified as VIP. Their average LTV is ${vip_ltv}.", "opportunity", "{vip} VIPs", "30d", "marts.dim_customers"),
    ("Data pipeline health check", "All 4 ETL pipelines have been monitored. Check incidents table for any active anomalies.", "info", "pipeline status", "24h", "raw.pipeline_runs"),
    ("Peak taxi demand hours identified", "Rush-hour windows show highest trip concentration. Surge pricing opportunities exist during peak hours.", "opportunity", "demand pattern", "7d", "marts.fct_trips"),
    ("Customer segmentation complete", "Customer base segmented into VIP ({vip}), Regular, and Occasional tiers based on lifetime value.", "info", "3 segments", "30d", "marts.dim_customers"),
    ("Taxi zone traffic distribution", "High-traffic zones drive the majority of revenue. Focus fleet allocation on top zones.", "opportunity", "zone concentration", "30d", "marts.dim_taxi_zones"),
    ("E-commerce order volume trend", "Monthly order volume of {eco_ord} units. Monitor for seasonal patterns and demand shifts.", "info", "{eco_ord} orders", "30d", "marts.fct_ecommerce_summary"),
    ("Cost optimization savings tracked", "Query optimizer has identified savings opportunities. Review optimization history for details.", "opportunity", "cost savings", "30d", "public.query_optimizations"),
]

# Weak labels of failed runs in test order (label, measure, comparison, bound); a failed run that meets none
# is OTHER_FAILURE and a run that did not fail is NO_FAILURE. Codes of source types are their places.
WEAK_LABELS = [
    ("ZERO_LOAD", "loaded", "<", 10),
    ("PIPELINE_DELAY", "duration", ">", 600),
    ("NULL_SPIKE", "failed", ">", 10),
]
OTHER_FAILURE, NO_FAILURE = "CONSECUTIVE_FAILURES", "NORMAL"
DEFAULT_TRAINING_SECONDS = 120
