"""Cost analysis of a query log: anti-patterns, savings, hints, clause features, cost score.

Patterns are evaluated as expressions on the statement column, in one pass over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import constants as k
from tidemill.functions.exprs import rnd, safe_divide

FLAGS = "(?is)"


def _applies(name: str, dialect: Column) -> Column:
    only = k.DIALECT_ONLY.get(name)
    return F.lit(True) if only is None else F.lower(F.coalesce(dialect, F.lit(""))) == only


def _matches(name: str, regex: str) -> Column:
    sql = F.col("sql")
    if name == "NO_LIMIT":
        # Its look-ahead as two plain searches: the same statements match, without the backtracking.
        found = sql.rlike(FLAGS + r"\bFROM\b") & ~sql.rlike(FLAGS + r"\bLIMIT\b")
    else:
        found = sql.rlike(FLAGS + regex)
    return _applies(name, F.col("dialect")) & found


def lint(log: DataFrame, patterns=None) -> DataFrame:
    """One row per (query, anti-pattern): query_id, pattern, severity, impact."""
    found = F.array(*[
        F.when(_matches(name, regex),
               F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact")))
        for name, regex, severity, impact in (patterns or k.ANTI_PATTERNS)
    ])
    # Exploding and filtering evaluates each pattern once, in generated code; compacting the array first does not.
    return log.select("query_id", F.explode(found).alias("f")).filter(F.col("f").isNotNull()).select("query_id", "f.*")


def max_impact(log: DataFrame, patterns=None) -> DataFrame:
    """The log with each query's largest impact, without leaving the scan stage."""
    impacts = [F.when(_matches(name, regex), impact).otherwise(0) for name, regex, _, impact in (patterns or k.ANTI_PATTERNS)]
    return log.withColumn("max_impact", F.greatest(*impacts))


def savings_pct(impact: Column, before: Column, after: Column) -> Column:
    by_cost = F.greatest(F.lit(0.0), (before - after) / F.nullif(before, F.lit(0.0)) * 100)
    pct = (
        F.when((before == 0) & (after == 0), F.least(F.lit(85.0), impact * F.lit(0.7)))
        .when((before > 0) & (after > 0), by_cost).otherwise(0.0)
    )
    return pct


def dollar_savings(dialect: Column, before: Column, pct: Column) -> Column:
    """Dollars per 1000 runs."""
    per_run = (
        F.when(dialect == "snowflake", before / 1_000_000 * 0.001 * k.SNOWFLAKE_CREDIT_PRICE)
        .when(dialect == "bigquery", before / 1_000_000 * 10 / 1000 * k.BIGQUERY_TB_PRICE)
        .otherwise(before * 0.00001)
    )
    return rnd(per_run * (pct / 100) * 1000, 4)


def optimizations(log: DataFrame, patterns=None) -> DataFrame:
    """Savings per query of the log."""
    before, after = F.col("original_cost"), F.col("optimized_cost")
    pct = savings_pct(F.col("max_impact"), before, after)
    return max_impact(log, patterns).select(
        "query_id", "dialect", "context", "created_at", "max_impact", rnd(pct, 1).alias("savings_percent"),
        dollar_savings(F.col("dialect"), before, pct).alias("dollar_savings"))


def total_savings(opt: DataFrame) -> DataFrame:
    dollars, pct = F.col("dollar_savings").cast("decimal(18,4)"), F.col("savings_percent").cast("decimal(18,1)")
    return opt.agg(
        F.count("*").alias("total_queries_optimized"), rnd(F.coalesce(F.sum(dollars), F.lit(0)), 4).alias("total_dollar_savings"),
        rnd(F.coalesce(safe_divide(F.sum(pct), F.count("*")), F.lit(0.0)), 4).alias("avg_savings_percent"))


def savings_by_context(opt: DataFrame) -> DataFrame:
    c = F.col("context")
    group = (
        F.when(c.like("dbt:staging%"), "dbt:staging").when(c.like("dbt:mart%"), "dbt:mart")
        .when(c == "analyst", "analyst").otherwise("manual")
    )
    dollars, pct = F.col("dollar_savings").cast("decimal(18,4)"), F.col("savings_percent").cast("decimal(18,1)")
    return opt.groupBy(group.alias("context")).agg(
        F.count("*").alias("query_count"), rnd(F.sum(dollars), 4).alias("total_saved"),
        rnd(safe_divide(F.sum(pct), F.count("*")), 1).alias("avg_pct"))


def newest(opt: DataFrame, n: int = 20) -> DataFrame:
    return opt.orderBy(F.desc("created_at"), F.desc("query_id")).limit(n)


# Which word list decides for which caller.
WRITE_GUARDS = {
    "is_write": k.WRITE_WORDS,
    "is_write_for_analyst": k.WRITE_WORDS_ANALYST,
    "is_write_for_optimizer": k.WRITE_WORDS_OPTIMIZER,
    "is_write_for_rules": k.WRITE_WORDS_RULES,
}


def write_flags(log: DataFrame) -> DataFrame:
    """Whether a statement holds a write word, one flag per word list."""
    text = F.upper(F.trim("sql"))
    return log.select("query_id", *[
        text.rlike(r"\b(" + "|".join(words) + r")\b").alias(name) for name, words in WRITE_GUARDS.items()])


def hints(log: DataFrame) -> DataFrame:
    """(query_id, hint): star, missing_limit, in_subquery, or_in_where, distinct_group_by, many_joins."""
    def m(regex: str) -> Column:
        return F.col("sql").rlike("(?i)" + regex)

    rules = {
        "star": m(r"SELECT\s+\*"),
        "missing_limit": ~m(r"\bLIMIT\b") & ~m(r"\bGROUP\s+BY\b"),
        "in_subquery": m(r"\bIN\s*\(\s*SELECT\b"),
        "or_in_where": m(r"\bOR\b") & m(r"\bWHERE\b"),
        "distinct_group_by": m("DISTINCT") & m(r"GROUP\s+BY"),
        "many_joins": F.regexp_count("sql", F.lit(r"(?i)\bJOIN\b")) >= 4,
    }
    found = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return log.select("query_id", F.explode(found).alias("hint")).filter(F.col("hint").isNotNull())


# Clause patterns of a statement.
CLAUSES = {
    "has_select": r"\bSELECT\b", "has_from": r"\bFROM\b", "has_where": r"\bWHERE\b", "has_group_by": r"\bGROUP BY\b",
    "has_order_by": r"\bORDER BY\b", "has_limit": r"\bLIMIT\b", "has_join": r"\bJOIN\b", "has_subquery": r"\(\s*SELECT\b",
    "has_window": r"\bOVER\s*\(", "has_having": r"\bHAVING\b", "has_distinct": r"\bDISTINCT\b",
}
UNSAFE = r"\b(INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE)\b"


def _normal() -> Column:
    return F.upper(F.regexp_replace(F.trim("sql"), r"\s+", " "))


def clause_features(log: DataFrame) -> DataFrame:
    """Clause flags, distinct aggregate names and layered tables of each statement."""
    def names(regex: str, text: Column) -> Column:
        found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(regex), F.lit(0))))
        return F.array_join(found, ",")

    n = F.col("_n")
    return log.withColumn("_n", _normal()).select(
        "query_id", *[n.rlike(p).alias(name) for name, p in CLAUSES.items()], (~n.rlike(UNSAFE)).alias("is_select_only"),
        names(r"\b(COUNT|SUM|AVG|MIN|MAX)\b", n).alias("agg_functions"),
        names(r"\b(raw|staging|marts)\.\w+", F.lower(n)).alias("tables"))


def cost_score(log: DataFrame) -> DataFrame:
    """Heuristic cost with its credits and dollars."""
    text = F.upper("sql")
    score = F.lit(k.COST_BASE)
    for regex, present, weight in k.COST_WEIGHTS:
        hit = text.rlike(regex)
        score = score + F.when(hit if present else ~hit, weight).otherwise(0)
    score = F.greatest(F.lit(k.COST_FLOOR), score)
    credits = rnd(score * F.lit(k.CREDITS_PER_COST_UNIT), 6)
    return log.select("query_id", score.alias("cost"), credits.alias("credits"),
                      rnd(credits * F.lit(k.SNOWFLAKE_CREDIT_PRICE), 6).alias("dollars"))


def detector_accuracy(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Per pattern: expected, found and matched queries, recall % and false alarms."""
    both = findings.select("query_id", "pattern", F.lit(1).alias("f")).join(
        expected.select("query_id", "pattern", F.lit(1).alias("e")), ["query_id", "pattern"], "full_outer")
    hit = F.col("f").isNotNull() & F.col("e").isNotNull()
    return both.groupBy("pattern").agg(
        F.count("e").alias("expected"), F.count("f").alias("found"), F.count_if(hit).alias("matched"),
        F.count_if(F.col("e").isNull()).alias("false_alarms"),
        rnd(100.0 * safe_divide(F.count_if(hit), F.count("e")), 1).alias("accuracy_pct"))


def component_match(features: DataFrame, expected: dict[str, Column], agg: Column | None = None) -> DataFrame:
    """Share of expected clauses a statement has; SELECT and FROM always count, unsafe statements score 0.

    ``expected`` maps a clause flag to whether it is expected; ``agg`` is an expected aggregate name or null.
    """
    zero = F.lit(0)
    total, matched = F.lit(2), F.col("has_select").cast("int") + F.col("has_from").cast("int")
    for flag, wanted in expected.items():
        total = total + F.when(wanted, 1).otherwise(0)
        matched = matched + F.when(wanted & F.col(flag), 1).otherwise(0)
    if agg is not None:
        has = F.array_contains(F.split("agg_functions", ","), agg)
        total = total + F.when(agg.isNotNull(), 1).otherwise(0)
        matched = matched + F.when(agg.isNotNull() & has, 1).otherwise(zero)
    score = F.when(~F.col("is_select_only"), 0.0).otherwise(rnd(safe_divide(matched, total), 3))
    return features.select("query_id", score.alias("component_score"))


def keyword_score(log: DataFrame, keywords: Column) -> DataFrame:
    """Share of expected keywords that occur in the statement, case-insensitive."""
    hits = F.size(F.filter(keywords, lambda w: F.contains(F.lower("sql"), F.lower(w))))
    return log.select("query_id", rnd(safe_divide(hits, F.size(keywords)), 3).alias("keyword_score"))
