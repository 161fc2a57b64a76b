"""Queries: cost analysis of the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import constants as k
from tidemill.operators import querylog as ql
from tidemill.plans.oracle import R, arr, lit
from tidemill.plans.registry import query
from tidemill.sources.bindings import STATEMENTS
from tidemill.sources.readers import spread


def _log(t):
    return spread(t.query_log)


# DuckDB's regular expressions have no look-around, so those conditions are spelled out. For the implicit
# join, the blank after each JOIN is replaced first: that is where the look-behind forbids a match to start.
_NO_LOOK = {
    "CARTESIAN_JOIN": "regexp_matches(regexp_replace(sql, '(?i)\\bJOIN\\s', 'JOIN#', 'g'), '(?is)\\bFROM\\b.{1,300}\\s+\\w[\\w.]*\\s*,\\s*\\w[\\w.]*')",
    "NO_LIMIT": "regexp_matches(sql, '(?is)\\bFROM\\b') AND NOT regexp_matches(sql, '(?is)\\bLIMIT\\b')",
    "SNOWFLAKE_NO_CLUSTERING": "regexp_matches(sql, '(?is)\\bFROM\\s+\\w+\\b') AND NOT regexp_matches(sql, '(?is)\\bCLUSTER\\s+BY\\b')",
    "BQ_NO_PARTITION_FILTER": "regexp_matches(sql, '(?is)FROM\\s+`[\\w.\\-]+`') AND NOT regexp_matches(sql, '(?is)\\bWHERE\\b.*(_PARTITIONDATE|partition_date|event_date)')",
    "REDSHIFT_NO_SORTKEY": "regexp_matches(sql, '(?is)\\bORDER\\s+BY\\b') AND NOT regexp_matches(sql, '(?is)\\bSORT\\s+KEY\\b')",
}


def _cond(name: str, regex: str) -> str:
    base = _NO_LOOK.get(name, f"regexp_matches(sql, {lit('(?is)' + regex)})")
    if name in k.DIALECT_ONLY:
        base = f"({base}) AND lower(dialect) = {lit(k.DIALECT_ONLY[name])}"
    return f"({base})"


_HITS = " UNION ALL ".join(
    f"SELECT query_id, {lit(n)} AS pattern, {lit(s)} AS severity, {i} AS impact FROM query_log WHERE {_cond(n, r)}" for n, r, s, i in k.ANTI_PATTERNS)


@query("c01_anti_patterns", _HITS, "query_log")
def _(t):
    return ql.lint(_log(t))


@query("c01_anti_pattern_counts", f"SELECT pattern, severity, impact, count(*) AS queries FROM ({_HITS}) GROUP BY 1, 2, 3", "query_log")
def _(t):
    return ql.lint(_log(t)).groupBy("pattern", "severity", "impact").agg(F.count("*").alias("queries"))


_PCT = """CASE WHEN original_cost = 0 AND optimized_cost = 0 THEN least(85.0::DOUBLE, impact * 0.7::DOUBLE)
    WHEN original_cost > 0 AND optimized_cost > 0 THEN greatest(0.0::DOUBLE, (original_cost - optimized_cost) / original_cost * 100) ELSE 0.0::DOUBLE END"""
_IMPACT = "greatest(" + ", ".join(f"CASE WHEN {_cond(n, r)} THEN {i} ELSE 0 END" for n, r, _, i in k.ANTI_PATTERNS) + ")"
_USD = f"""CASE dialect WHEN 'snowflake' THEN original_cost / 1000000 * 0.001::DOUBLE * 2.5::DOUBLE WHEN 'bigquery' THEN original_cost / 1000000 * 10 / 1000 * 5.0::DOUBLE
    ELSE original_cost * 0.00001::DOUBLE END * (pct / 100) * 1000"""
_OPT = f"""im AS (SELECT *, {_IMPACT} AS impact FROM query_log), pc AS (SELECT *, {_PCT} AS pct FROM im),
    opt AS (SELECT query_id, dialect, context, created_at, impact AS max_impact, {R('pct', 1)} AS savings_percent, {R(_USD, 4)} AS dollar_savings FROM pc)"""


def _opt(t):
    return ql.optimizations(_log(t))


@query("c02_savings", f"WITH {_OPT} SELECT query_id, max_impact, savings_percent FROM opt", "query_log")
def _(t):
    return _opt(t).select("query_id", "max_impact", "savings_percent")


@query("c03_dollar_savings", f"WITH {_OPT} SELECT query_id, dialect, dollar_savings FROM opt", "query_log")
def _(t):
    return _opt(t).select("query_id", "dialect", "dollar_savings")


@query("c04_total_savings", f"""WITH {_OPT} SELECT count(*) AS total_queries_optimized, {R('sum(CAST(dollar_savings AS DECIMAL(18,4)))', 4)} AS total_dollar_savings,
    {R('CAST(sum(CAST(savings_percent AS DECIMAL(18,1))) AS DOUBLE) / count(*)', 4)} AS avg_savings_percent FROM opt""", "query_log")
def _(t):
    return ql.total_savings(_opt(t))


@query("c05_savings_by_context", f"""WITH {_OPT} SELECT CASE WHEN context LIKE 'dbt:staging%' THEN 'dbt:staging' WHEN context LIKE 'dbt:mart%' THEN 'dbt:mart'
    WHEN context = 'analyst' THEN 'analyst' ELSE 'manual' END AS context, count(*) AS query_count, {R('sum(CAST(dollar_savings AS DECIMAL(18,4)))', 4)} AS total_saved,
    {R('CAST(sum(CAST(savings_percent AS DECIMAL(18,1))) AS DOUBLE) / count(*)', 1)} AS avg_pct FROM opt GROUP BY 1""", "query_log")
def _(t):
    return ql.savings_by_context(_opt(t))


@query("c06_newest", f"WITH {_OPT} SELECT query_id, savings_percent, context, created_at FROM opt ORDER BY created_at DESC, query_id DESC LIMIT 20", "query_log")
def _(t):
    return ql.newest(_opt(t)).select("query_id", "savings_percent", "context", "created_at")


_GUARDS = ", ".join(f"regexp_matches(upper(trim(sql)), '\\b({'|'.join(words)})\\b') AS {name}" for name, words in ql.WRITE_GUARDS.items())


@query("c07_write_flags", f"SELECT query_id, {_GUARDS} FROM query_log", "query_log")
def _(t):
    return ql.write_flags(_log(t))


_HINTS = {
    "star": "regexp_matches(sql, '(?i)SELECT\\s+\\*')",
    "missing_limit": "NOT regexp_matches(sql, '(?i)\\bLIMIT\\b') AND NOT regexp_matches(sql, '(?i)\\bGROUP\\s+BY\\b')",
    "in_subquery": "regexp_matches(sql, '(?i)\\bIN\\s*\\(\\s*SELECT\\b')",
    "or_in_where": "regexp_matches(sql, '(?i)\\bOR\\b') AND regexp_matches(sql, '(?i)\\bWHERE\\b')",
    "distinct_group_by": "regexp_matches(sql, '(?i)DISTINCT') AND regexp_matches(sql, '(?i)GROUP\\s+BY')",
    "many_joins": "len(regexp_extract_all(sql, '(?i)\\bJOIN\\b')) >= 4",
}


@query("c08_hints", " UNION ALL ".join(f"SELECT query_id, {lit(h)} AS hint FROM query_log WHERE {c}" for h, c in _HINTS.items()), "query_log")
def _(t):
    return ql.hints(_log(t))


_NORM = "n AS (SELECT *, upper(regexp_replace(trim(sql), '\\s+', ' ', 'g')) AS u FROM query_log)"
_FEATURES = ", ".join(f"regexp_matches(u, {lit(p)}) AS {name}" for name, p in ql.CLAUSES.items())
_FEAT = f"""{_NORM}, feat AS (SELECT query_id, {_FEATURES}, NOT regexp_matches(u, {lit(ql.UNSAFE)}) AS is_select_only,
    array_to_string(list_sort(list_distinct(regexp_extract_all(u, '\\b(COUNT|SUM|AVG|MIN|MAX)\\b'))), ',') AS agg_functions,
    array_to_string(list_sort(list_distinct(regexp_extract_all(lower(u), '\\b(raw|staging|marts)\\.\\w+'))), ',') AS tables FROM n)"""


@query("c09_clause_features", f"WITH {_FEAT} SELECT * REPLACE (coalesce(agg_functions, '') AS agg_functions, coalesce(tables, '') AS tables) FROM feat", "query_log")
def _(t):
    return ql.clause_features(_log(t))


_SCORE = f"greatest({k.COST_FLOOR}, {k.COST_BASE}" + "".join(
    f" + CASE WHEN {'' if present else 'NOT '}regexp_matches(upper(sql), {lit(rx)}) THEN {w} ELSE 0 END" for rx, present, w in k.COST_WEIGHTS) + ")"


@query("c11_cost_score", f"""SELECT query_id, cost, credits, {R('credits * 2.5', 6)} AS dollars FROM (SELECT query_id, CAST({_SCORE} AS INTEGER) AS cost,
    {R(f'{_SCORE} * 0.001::DOUBLE', 6)} AS credits FROM query_log)""", "query_log")
def _(t):
    return ql.cost_score(_log(t))


# What a reader expects of each statement shape.
_EXPECTED = [["SELECT_STAR"], [], ["DISTINCT_ON_GROUP_BY"], ["NO_LIMIT"], ["CORRELATED_SUBQUERY"], ["OR_IN_WHERE"], ["LIKE_LEADING_WILDCARD"],
             ["FUNCTION_ON_INDEXED_COL"], ["SUBQUERY_IN_SELECT"], ["FULL_TABLE_SCAN"], [], ["SELECT_STAR"], [], ["MYSQL_IMPLICIT_CONVERSION"], [], [], [], []]
_EXP = "e AS (SELECT query_id, unnest([" + ", ".join(f"{arr(x)}::VARCHAR[]" for x in _EXPECTED) + f"][query_id % {len(STATEMENTS)} + 1]) AS pattern FROM query_log)"


@query("c12_detector_accuracy", f"""WITH {_EXP}, f AS ({_HITS}), j AS (SELECT coalesce(f.pattern, e.pattern) AS pattern, f.query_id AS fq, e.query_id AS eq
        FROM f FULL OUTER JOIN e ON f.query_id = e.query_id AND f.pattern = e.pattern)
    SELECT pattern, count(eq) AS expected, count(fq) AS found, count(*) FILTER (WHERE eq IS NOT NULL AND fq IS NOT NULL) AS matched,
        count(*) FILTER (WHERE eq IS NULL) AS false_alarms,
        {R('100.0::DOUBLE * (count(*) FILTER (WHERE eq IS NOT NULL AND fq IS NOT NULL) / nullif(CAST(count(eq) AS DOUBLE), 0))', 1)} AS accuracy_pct FROM j GROUP BY 1""", "query_log")
def _(t):
    shapes = F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in _EXPECTED])
    expected = _log(t).select("query_id", F.explode(F.element_at(shapes, (F.col("query_id") % len(STATEMENTS) + 1).cast("int"))).alias("pattern"))
    return ql.detector_accuracy(ql.lint(_log(t)), expected)


@query("c13_component_match", f"""WITH {_FEAT}, w AS (SELECT *, query_id % 2 = 0 AS ew, query_id % 3 = 0 AS eg, query_id % 5 = 0 AS el,
        CASE WHEN query_id % 4 = 0 THEN 'COUNT' END AS ea FROM feat)
    SELECT query_id, CASE WHEN NOT is_select_only THEN 0.0::DOUBLE ELSE {R('''(CAST(has_select AS INTEGER) + CAST(has_from AS INTEGER) + CASE WHEN ew AND has_where THEN 1 ELSE 0 END
        + CASE WHEN eg AND has_group_by THEN 1 ELSE 0 END + CASE WHEN el AND has_limit THEN 1 ELSE 0 END
        + CASE WHEN ea IS NOT NULL AND list_contains(string_split(agg_functions, ','), ea) THEN 1 ELSE 0 END)
        / CAST(2 + CAST(ew AS INTEGER) + CAST(eg AS INTEGER) + CAST(el AS INTEGER) + CASE WHEN ea IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE)''', 3)} END AS component_score FROM w""", "query_log")
def _(t):
    q = F.col("query_id")
    return ql.component_match(ql.clause_features(_log(t)), {"has_where": q % 2 == 0, "has_group_by": q % 3 == 0, "has_limit": q % 5 == 0},
                              F.when(q % 4 == 0, "COUNT"))


@query("c13_keyword_score", f"""SELECT query_id, {R("(CASE WHEN contains(lower(sql), 'count') THEN 1 ELSE 0 END + CASE WHEN contains(lower(sql), 'group by') THEN 1 ELSE 0 END + CASE WHEN contains(lower(sql), 'orders') THEN 1 ELSE 0 END) / 3.0::DOUBLE", 3)} AS keyword_score FROM query_log""", "query_log")
def _(t):
    return ql.keyword_score(_log(t), F.array(*map(F.lit, ["COUNT", "GROUP BY", "orders"])))

