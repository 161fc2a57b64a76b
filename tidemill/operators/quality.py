"""Data quality: column profile, health score, rules, schema snapshots and drift, personal-data columns.

All measures of one table come from one scan: a single aggregate over all columns, then unpivoted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.constants import PII_PATTERNS, WRITE_WORDS_RULES
from tidemill.functions.exprs import dbl, numeric_columns, rnd, safe_divide, temporal_columns



def _bound_text(c: Column, type_name: str) -> Column:
    """Doubles with six decimals; those that do not fit (huge, infinite, NaN) as they print."""
    if type_name in ("double", "float"):
        return F.coalesce(c.try_cast("decimal(38,6)").cast("string"), c.cast("string"))
    return c.cast("string")


def profile(df: DataFrame, table: str, approx_distinct: bool = False) -> DataFrame:
    """One row per column: rows, null %, distinct count, min and max as text (numbers and times only).

    The exact distinct counts expand each row once per column inside the scan stage; for very wide
    tables ``approx_distinct`` keeps one sketch per column instead.
    """
    distinct = F.approx_count_distinct if approx_distinct else F.count_distinct
    bounded = set(numeric_columns(df)) | set(temporal_columns(df))
    types = dict(df.dtypes)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"f{i}"), distinct(c).alias(f"d{i}")]
        if c in bounded:
            aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            rnd(100.0 * safe_divide(F.col("n") - F.col(f"f{i}"), F.col("n")), 1).alias("null_pct"),
            F.col(f"d{i}").alias("distinct_count"),
            (_bound_text(F.col(f"a{i}"), types[c]) if c in bounded else F.lit(None).cast("string")).alias("min_value"),
            (_bound_text(F.col(f"b{i}"), types[c]) if c in bounded else F.lit(None).cast("string")).alias("max_value"),
        )
        for i, c in enumerate(df.columns)
    ])
    return df.agg(*aggs).select(F.lit(table).alias("table_name"), F.col("n").alias("row_count"), F.inline(rows))


def null_shares(df: DataFrame) -> DataFrame:
    """One row: n and the null share per column as an array of structs."""
    aggs = [F.count("*").alias("n")] + [F.count(c).alias(f"f{i}") for i, c in enumerate(df.columns)]
    shares = F.array(*[
        F.struct(F.lit(c).alias("column_name"), safe_divide(F.col("n") - F.col(f"f{i}"), F.col("n")).alias("null_share"))
        for i, c in enumerate(df.columns)
    ])
    return df.agg(*aggs).select("n", shares.alias("shares"))


def health_score(profiled: DataFrame) -> DataFrame:
    """Score per table: max(0, 100 - int(average null % * 2)); 100 when no null % is known."""
    average = F.avg("null_pct")
    score = F.greatest(F.lit(0), 100 - F.floor(rnd(average * 2, 6)).cast("int"))
    return profiled.groupBy("table_name").agg(F.when(average.isNull(), 100).otherwise(score).alias("health_score"))


def health_label(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 50, "warning").otherwise("critical")


def first_column_health(tables: dict[str, DataFrame]) -> DataFrame:
    """Health per table from its first column only."""
    parts = []
    for name, df in tables.items():
        first = df.columns[0]
        share = rnd(100.0 * safe_divide(F.count("*") - F.count(first), F.count("*")), 1)
        score = F.greatest(F.lit(0), 100 - F.floor(F.coalesce(share, F.lit(0.0)) * 2).cast("int"))
        parts.append(df.agg(F.count("*").alias("row_count"), score.alias("health_score")).select(
            F.lit(name).alias("table_name"), "row_count", "health_score"))
    return reduce(DataFrame.unionByName, parts).withColumn("health", health_label(F.col("health_score")))


@dataclass(frozen=True)
class Rule:
    """A quality rule. Kinds: not_null, uniqueness, row_count, freshness, range, regex, referential, custom_sql."""
    rule_id: str
    table: str
    kind: str
    column: str | None = None
    threshold: float = 0.0
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None
    sql: str | None = None
    enabled: bool = True
    extra: dict = field(default_factory=dict)


def _rule_aggs(r: Rule, as_of: Column) -> tuple[Column, Column, Column]:
    """(metric, failed, error rows) of a rule as aggregates over its table."""
    n = F.count("*")
    if r.kind == "row_count":
        return dbl(n), n < r.threshold, F.lit(0).cast("bigint")
    c = F.col(r.column)
    if r.kind == "not_null":
        bad = n - F.count(c)
        pct = 100.0 * F.coalesce(safe_divide(bad, n), F.lit(0.0))
        return pct, pct > r.threshold, bad
    if r.kind == "uniqueness":
        # Nulls count as duplicates, because the distinct count skips them.
        bad = n - F.count_distinct(c)
        pct = 100.0 * F.coalesce(safe_divide(bad, n), F.lit(0.0))
        return pct, pct > r.threshold, bad
    if r.kind == "freshness":
        hours = F.timestamp_diff("MICROSECOND", F.max(c), F.max(as_of)) / F.lit(3.6e9)
        return hours, F.coalesce(hours > r.threshold, F.lit(True)), F.lit(0).cast("bigint")
    if r.kind == "range":
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (c < r.low)
        if r.high is not None:
            outside = outside | (c > r.high)
        bad = F.count_if(outside)
        return dbl(bad), bad > r.threshold, bad
    if r.kind == "regex":
        bad = F.count_if(~c.rlike(r.pattern))
        return dbl(bad), bad > r.threshold, bad
    raise ValueError(f"unknown rule kind {r.kind}")


def run_rules(tables: dict[str, DataFrame], rules: list[Rule], as_of: Column) -> DataFrame:
    """One result row per enabled rule; the column rules of a table share one scan."""
    parts = []
    enabled = [r for r in rules if r.enabled]
    for table in dict.fromkeys(r.table for r in enabled):
        df = tables[table]
        fused = [r for r in enabled if r.table == table and r.kind not in ("referential", "custom_sql")]
        if fused:
            dated = df.withColumn("_as_of", as_of)
            aggs = [F.count("*").alias("row_count")]
            for i, r in enumerate(fused):
                metric, failed, bad = _rule_aggs(r, F.col("_as_of"))
                aggs += [metric.alias(f"m{i}"), failed.alias(f"x{i}"), bad.alias(f"e{i}")]
                if r.kind == "range":
                    aggs += [dbl(F.min(r.column)).alias(f"a{i}"), dbl(F.max(r.column)).alias(f"b{i}")]
            rows = F.array(*[
                _result(r, F.col(f"m{i}"), F.col(f"x{i}"), F.col(f"e{i}"),
                        *((F.col(f"a{i}"), F.col(f"b{i}")) if r.kind == "range" else ()))
                for i, r in enumerate(fused)])
            parts.append(dated.agg(*aggs).select("row_count", F.inline(rows)))
        for r in enabled:
            if r.table == table and r.kind == "referential":
                orphans = df.filter(F.col(r.column).isNotNull()).join(
                    tables[r.ref_table].select(F.col(r.ref_column).alias(r.column)), r.column, "left_anti")
                n = df.agg(F.count("*")).scalar()
                one = orphans.agg(F.count("*").alias("bad"))
                parts.append(one.select(n.alias("row_count"), F.inline(F.array(
                    _result(r, dbl(F.col("bad")), F.col("bad") > r.threshold, F.col("bad"))))))
            elif r.table == table and r.kind == "custom_sql":
                ok = _first_cell_truthy(df.sparkSession, tables, r.sql)
                n = df.agg(F.count("*").alias("row_count"))
                parts.append(n.select("row_count", F.inline(F.array(
                    _result(r, F.lit(1.0 if ok else 0.0), F.lit(not ok), F.lit(0).cast("bigint"))))))
    return reduce(DataFrame.unionByName, parts)


def _result(r: Rule, metric: Column, failed: Column, bad: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """A result row; a range rule also tells the smallest and largest value."""
    nothing = F.lit(None).cast("double")
    low, high = nothing if low is None else low, nothing if high is None else high

    def text(c: Column) -> Column:
        return c.cast("decimal(30,4)").cast("string")

    message = F.concat(
        F.lit(f"{r.kind}{' of ' + r.column if r.column else ''}: "), F.coalesce(text(rnd(metric, 4)), F.lit("no value")),
        F.lit(f", threshold {r.threshold:.4f}"),
        F.coalesce(F.concat(F.lit(", values "), text(rnd(low, 4)), F.lit(" to "), text(rnd(high, 4))), F.lit("")))
    return F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.table).alias("table_name"), F.lit(r.kind).alias("kind"),
        F.when(failed, "fail").otherwise("pass").alias("status"), rnd(metric, 4).alias("metric"),
        F.lit(float(r.threshold)).alias("threshold"), bad.alias("error_rows"),
        rnd(low, 4).alias("min_value"), rnd(high, 4).alias("max_value"), message.alias("message"),
    )


def _first_cell_truthy(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> bool:
    if re.search(r"\b(" + "|".join(WRITE_WORDS_RULES) + r")\b", sql, re.I):
        raise ValueError("custom_sql rules must only read")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    row = spark.sql(sql).first()
    return bool(row and row[0])


def quality_summary(tables: int, results: DataFrame, rules: list[Rule], drift: DataFrame) -> DataFrame:
    """Counts and overall state: good without failures, warning below 3, else critical."""
    open_drift = drift.agg(F.count("*")).scalar()
    failing = F.col("failing")
    return results.agg(F.count_if(F.col("status") == "fail").alias("failing")).select(
        F.lit(tables).alias("tables"), F.lit(sum(r.enabled for r in rules)).alias("enabled_rules"), "failing",
        open_drift.alias("open_drift"),
        F.when(failing == 0, "good").when(failing < 3, "warning").otherwise("critical").alias("overall"),
    )


def schema_snapshot(df: DataFrame, table: str) -> DataFrame:
    """Ordered columns with type and nullability, plus the row count."""
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"))
        for i, f in enumerate(df.schema.fields)
    ])
    return df.agg(F.count("*").alias("row_count")).select(F.lit(table).alias("table_name"), "row_count", F.inline(rows))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events between two snapshots (table_name, column_name, data_type, nullable).

    table_added / table_removed once per table; column_added / column_removed / type_changed /
    constraint_changed for tables on both sides.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("table_name", "column_name", F.col("data_type").alias(f"{tag}_type"),
                         F.col("nullable").alias(f"{tag}_nullable"), F.lit(True).alias(f"in_{tag}"))

    columns = side(old, "old").join(side(new, "new"), ["table_name", "column_name"], "full_outer")
    tables = columns.groupBy("table_name").agg(
        F.bool_or(F.coalesce("in_old", F.lit(False))).alias("was"), F.bool_or(F.coalesce("in_new", F.lit(False))).alias("is"))
    whole = tables.filter(F.col("was") != F.col("is")).select(
        "table_name", F.lit(None).cast("string").alias("column_name"),
        F.when(F.col("is"), "table_added").otherwise("table_removed").alias("event_type"),
        F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"))
    kind = (
        F.when(F.col("in_old").isNull(), "column_added")
        .when(F.col("in_new").isNull(), "column_removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
        .when(F.col("old_nullable") != F.col("new_nullable"), "constraint_changed")
    )
    nullable = F.col("event_type") == "constraint_changed"
    changed = (
        columns.join(tables.filter(F.col("was") & F.col("is")).select("table_name"), "table_name")
        .withColumn("event_type", kind).filter(F.col("event_type").isNotNull())
        .select(
            "table_name", "column_name", "event_type",
            F.when(nullable, F.col("old_nullable").cast("string")).otherwise(F.col("old_type")).alias("old_value"),
            F.when(nullable, F.col("new_nullable").cast("string")).otherwise(F.col("new_type")).alias("new_value"))
    )
    return whole.unionByName(changed)


def load_check(df: DataFrame, table: str) -> DataFrame:
    """error for an empty table, warning per column with more than 10 % nulls."""
    shares = null_shares(df)
    empty = shares.filter(F.col("n") == 0).select(
        F.lit(table).alias("table_name"), F.lit(None).cast("string").alias("column_name"),
        F.lit("error").alias("level"), F.lit(None).cast("double").alias("null_pct"))
    heavy = shares.select(F.inline("shares")).filter(F.col("null_share") > 0.10).select(
        F.lit(table).alias("table_name"), "column_name", F.lit("warning").alias("level"),
        rnd(F.col("null_share") * 100, 1).alias("null_pct"))
    return empty.unionByName(heavy)


def classify_pii(columns: DataFrame, name_col: str = "column_name") -> DataFrame:
    """Columns whose lower-cased name matches a pattern: kind, severity and confidence of the first match."""
    name = F.lower(F.col(name_col))
    kind, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, label, level in reversed(PII_PATTERNS):
        hit = name.rlike(pattern)
        kind, severity = F.when(hit, label).otherwise(kind), F.when(hit, level).otherwise(severity)
    return columns.withColumns({"pii_type": kind, "severity": severity, "confidence": F.lit(0.95)}).filter(
        F.col("pii_type").isNotNull())


def pii_rollup(findings: DataFrame) -> DataFrame:
    """Findings per table with counts per severity, suppressed ones left out of the counts."""
    def live(level: str) -> Column:
        return F.count_if((F.col("severity") == level) & ~F.col("suppressed")).alias(level)

    return findings.groupBy("table_name").agg(F.count("*").alias("total"), live("high"), live("medium"), live("low"))


def suppress_findings(findings: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the chosen findings suppressed."""
    marks = chosen.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return findings.join(marks, keys, "left").withColumn(
        "suppressed", F.col("suppressed") | F.coalesce("_hit", F.lit(False))).drop("_hit")
