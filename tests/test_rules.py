"""Rule semantics on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.functions.constants import ALERT_RULES, DIAGNOSES, ERROR_SIGNATURES
from tidemill.operators import anomalies as an
from tidemill.operators import outcomes as oc
from tidemill.operators import quality as q
from tidemill.operators import querylog as ql
from tidemill.operators import validate as va

def signature_type(text):
    """The type of the first signature that a text holds."""
    return next(kind for part, kind in ERROR_SIGNATURES if part in text.lower())


MESSAGES = [(f"Step {i} of 9 gave up [{text.upper()}] at noon", signature_type(text)) for i, (text, _) in enumerate(ERROR_SIGNATURES)]
MESSAGES += [("executor lost, then disk full", signature_type("executor lost, then disk full")),
             ("an unheard-of trouble", None), ("", "UNKNOWN"), (None, "UNKNOWN")]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_error_messages(spark):
    df = spark.createDataFrame(MESSAGES, "m string, want string")
    assert df.filter(~an.classify_error(F.col("m")).eqNullSafe(F.col("want"))).count() == 0


def test_row_drop(spark):
    assert value(spark, an.row_drop(F.lit(50), F.lit(100.0))) == 0.5
    assert value(spark, an.row_drop(F.lit(90), F.lit(100.0))) is None
    assert value(spark, an.row_drop(F.lit(80), F.lit(100.0))) is None
    assert value(spark, an.row_drop(F.lit(0), F.lit(0.0))) is None


def test_spikes_and_sla(spark):
    assert value(spark, an.null_spike(F.lit(0.35), F.lit(0.01)))
    assert not value(spark, an.null_spike(F.lit(0.35), F.lit(0.02)))
    assert value(spark, an.duplicate_spike(F.lit(0.12), F.lit(0.01)))
    assert value(spark, an.sla_breach(F.lit(1200), F.lit(300))) == 4.0
    assert value(spark, an.sla_breach(F.lit(900), F.lit(300))) is None


def run(no, flow, minute, status="success", loaded=100, failed=0, seconds=10.0, message=None):
    start = dt.datetime(2024, 3, 10, 12) + dt.timedelta(minutes=minute)
    return (no, flow, start, start + dt.timedelta(seconds=seconds), status, loaded, loaded + failed, failed, seconds, message, 0.0, 0.0)


SCHEMA = ("run_no int, pipeline_name string, started_at timestamp_ntz, completed_at timestamp_ntz, status string, records_loaded bigint, "
          "records_ingested bigint, records_failed bigint, duration_seconds double, error_message string, null_rate double, duplicate_rate double")


def test_winner_takes_the_first_rule(spark, rows):
    runs = spark.createDataFrame([
        run(1, "quiet", -500), run(2, "quiet", -5),
        run(3, "empty", -400), run(4, "empty", -4, loaded=0),
        run(5, "broken", -60), run(6, "broken", -30, "failed", 0, message="disk full"), run(7, "broken", -3, "failed", 0, message="disk full"),
        run(8, "once", -90), run(9, "once", -2, "failed", 0, message="column x does not exist"),
        run(10, "slow", -300), run(11, "slow", -200), run(12, "slow", -1, seconds=100.0),
    ], SCHEMA)
    as_of = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    found = an.detect(runs, as_of)
    assert rows(an.winners(found), "pipeline_name", "rule", "anomaly_type") == [
        ("broken", "consecutive_failures", "RATE_LIMIT_HIT"), ("empty", "zero_load", "ZERO_LOAD"),
        ("once", "schema_drift", "SCHEMA_DRIFT"), ("slow", "pipeline_delay", "PIPELINE_DELAY")]
    assert an.winners(found).groupBy("pipeline_name").count().filter("count > 1").count() == 0
    streaks = dict(rows(an.consecutive_failures(runs)))
    assert streaks == {"quiet": 0, "empty": 0, "broken": 2, "once": 1, "slow": 0}


def test_a_streak_of_a_thousand_runs_is_whole(spark, rows):
    data = [run(0, "long", -5000)] + [run(i, "long", i - 2000, "failed", 0, message="odd") for i in range(1, 1001)]
    data += [run(i, "whole", i - 9000, "failed", 0, message="odd") for i in range(2000, 2700)]
    runs = spark.createDataFrame(data, SCHEMA)
    assert dict(rows(an.consecutive_failures(runs))) == {"long": 1000, "whole": 700}
    found = an.detect(runs, F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")).filter("rule = 'consecutive_failures'")
    assert rows(found, "pipeline_name", "metric") == [("long", 1000.0), ("whole", 700.0)]


def test_a_cascade_without_the_owner_is_reported(spark, rows):
    data = [r for i, f in enumerate("bcd") for r in (run(2 * i, f, -100), run(2 * i + 1, f, -5, "failed", 0, message="odd"))]
    found = an.detect(spark.createDataFrame(data, SCHEMA), F.lit("2024-03-10 12:00:00").cast("timestamp_ntz"))
    assert rows(found.filter("rule = 'cascading_failure'"), "pipeline_name", "metric") == [("b", 3.0)]


def test_cascade_needs_three_failing_flows(spark, rows):
    def failing(n):
        names = ["ingest_nyc_taxi", "b", "c"][:n]
        data = [r for i, f in enumerate(names) for r in (run(2 * i, f, -100), run(2 * i + 1, f, -5, "failed", 0, message="odd"))]
        return an.detect(spark.createDataFrame(data, SCHEMA), F.lit("2024-03-10 12:00:00").cast("timestamp_ntz"))

    assert failing(2).filter("rule = 'cascading_failure'").count() == 0
    assert rows(failing(3).filter("rule = 'cascading_failure'"), "pipeline_name", "metric") == [("ingest_nyc_taxi", 3.0)]


def test_diagnosis(spark):
    df = spark.createDataFrame([("p", "r", "SLA_BREACH", 4.25), ("p", "r", "ODD", 0.0)], "pipeline_name string, rule string, anomaly_type string, metric double")
    got = {r.anomaly_type: r for r in an.diagnose(df).collect()}
    assert got["SLA_BREACH"].root_cause.startswith("Pipeline exceeded SLA by 4.3x")
    assert got["SLA_BREACH"].boosted_confidence == 0.8
    assert got["ODD"].confidence == 0.30 and got["ODD"].suggested_fix_type == "manual_review"
    assert "'ODD'" in got["ODD"].root_cause
    assert len(DIAGNOSES) == 14


def test_schedules(spark):
    cases = {"*/30 * * * *": 30, "@hourly": 60, "0 */6 * * *": 360, "*/7 * * * *": 7, "0 */5 * * *": 300, "": None, "weekly": None}
    df = spark.createDataFrame([(c,) for c in cases], "s string").select("s", an.schedule_minutes(F.col("s")).alias("m"))
    assert {r.s: r.m for r in df.collect()} == cases


def test_fix_counters(spark, rows):
    outcomes = spark.createDataFrame([("f", "A", "rejected", 480.0), ("g", "A", "approved", 360.0), ("g", "B", "approved", 252.0)],
                                     "fix_id string, anomaly_type string, outcome string, mttr_seconds double")
    fixes = oc.fix_library(outcomes)
    assert dict(rows(oc.mttr_by_anomaly(fixes))) == {"A": 7.0, "B": 4.2}
    again = oc.apply_outcomes(fixes, spark.createDataFrame([("f", "rejected")], "fix_id string, outcome string"))
    assert again.filter("fix_id = 'f'").first().deprecated
    assert not again.filter("fix_id = 'g' AND anomaly_type = 'A'").first().deprecated


def test_threshold_default_and_quality(spark):
    fixes = spark.createDataFrame([("f", "A", 1, 0, False), ("g", "A", 1, 0, False)],
                                  "fix_id string, anomaly_type string, success_count int, failure_count int, deprecated boolean")
    assert oc.learned_threshold(fixes).first().threshold == 0.75
    assert value(spark, oc.query_quality(F.lit(5), F.lit(100), F.lit(1))) == 1.0
    assert value(spark, oc.query_quality(F.lit(0), F.lit(20000), F.lit(-1))) == 0.2


def test_validation_measures(spark):
    assert value(spark, va.confidence(F.lit(18), F.lit(20))) == 0.9
    assert value(spark, va.confidence(F.lit(3), F.lit(0))) == 0.0
    assert value(spark, va.same_size(F.lit(100), F.lit(100)))
    assert not value(spark, va.same_size(F.lit(100), F.lit(50)))
    assert value(spark, va.same_size(F.lit(0), F.lit(0))) and not value(spark, va.same_size(F.lit(0), F.lit(1)))


def test_savings(spark):
    zero = F.lit(0.0)
    assert value(spark, F.round(ql.savings_pct(F.lit(50), zero, zero), 1)) == 35.0
    assert value(spark, F.round(ql.savings_pct(F.lit(90), zero, zero), 1)) == 63.0
    assert value(spark, ql.savings_pct(F.lit(50), F.lit(200.0), F.lit(50.0))) == 75.0
    assert value(spark, ql.savings_pct(F.lit(50), F.lit(50.0), F.lit(200.0))) == 0.0
    assert value(spark, ql.savings_pct(F.lit(50), F.lit(50.0), zero)) == 0.0


def test_lint(spark):
    log = spark.createDataFrame([
        (1, "SELECT * FROM t", "postgresql"), (2, "select a from t where b in (select c from u) limit 3", "postgresql"),
        (3, "SELECT a FROM t x, u y WHERE x.a = y.a LIMIT 1", "postgresql"), (4, "SELECT NOW() FROM t LIMIT 1", "snowflake"),
        (5, "SELECT NOW() FROM t LIMIT 1", None), (6, "DROP TABLE t", "mysql"),
    ], "query_id int, sql string, dialect string")
    found = {}
    for r in ql.lint(log).collect():
        found.setdefault(r.query_id, set()).add(r.pattern)
    assert {"SELECT_STAR", "NO_LIMIT", "FULL_TABLE_SCAN"} <= found[1]
    assert "CORRELATED_SUBQUERY" in found[2] and "NO_LIMIT" not in found[2]
    assert "CARTESIAN_JOIN" in found[3]
    assert "SNOWFLAKE_NON_RESULT_CACHE" in found[4] and "SNOWFLAKE_NON_RESULT_CACHE" not in found.get(5, set())
    assert [r.query_id for r in ql.write_flags(log).filter("is_write").collect()] == [6]


def test_pii_names(spark):
    df = spark.createDataFrame([("email",), ("user_email",), ("old_passwd",), ("First_Name",), ("total",)], "column_name string")
    assert {r.column_name: r.pii_type for r in q.classify_pii(df).collect()} == {
        "email": "Email Address", "old_passwd": "Password/Secret", "First_Name": "Full Name"}


def test_rules_on_empty_table(spark):
    empty = spark.createDataFrame([], "a int, at timestamp_ntz")
    rules = [q.Rule("n", "t", "not_null", "a", 0.0), q.Rule("f", "t", "freshness", "at", 1.0), q.Rule("r", "t", "row_count", threshold=1)]
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    got = {r.rule_id: r.status for r in q.run_rules({"t": empty}, rules, as_of).collect()}
    assert got == {"n": "pass", "f": "fail", "r": "fail"}
    assert q.health_score(q.profile(empty, "t")).first().health_score == 100
    with pytest.raises(ValueError):
        q.run_rules({"t": empty}, [q.Rule("w", "t", "custom_sql", sql="DROP TABLE t")], as_of)


def test_profile_of_a_union_adds_up(spark, tables):
    a, b = tables.orders.filter("o_orderkey < 500"), tables.orders.filter("o_orderkey >= 500")
    whole = {r.column_name: r.row_count for r in q.profile(tables.orders, "o").collect()}
    halves = [{r.column_name: r.row_count for r in q.profile(df, "o").collect()} for df in (a, b)]
    assert all(whole[c] == halves[0][c] + halves[1][c] for c in whole)


def test_one_sided_ranges_report_their_values(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 1.0, 9.0, None)], "v double")
    rules = [q.Rule("low", "t", "range", "v", low=0.0), q.Rule("high", "t", "range", "v", high=4.0), q.Rule("both", "t", "range", "v", low=0.0, high=4.0)]
    found = {r.rule_id: r for r in q.run_rules({"t": df}, rules, F.lit(None).cast("timestamp_ntz")).collect()}
    assert {k: r.error_rows for k, r in found.items()} == {"low": 1, "high": 1, "both": 2}
    assert {(r.min_value, r.max_value) for r in found.values()} == {(-5.0, 9.0)}
    assert found["both"].message == "range of v: 2.0000, threshold 0.0000, values -5.0000 to 9.0000"


def test_profile_of_extreme_doubles(spark):
    df = spark.createDataFrame([(1e33, 1.5), (-1e33, float("nan"))], "huge double, odd double")
    rows = {r.column_name: (r.min_value, r.max_value) for r in q.profile(df, "t").collect()}
    assert rows == {"huge": ("-1.0E33", "1.0E33"), "odd": ("1.500000", "NaN")}


def test_rules_that_are_off_raise_no_alert(spark):
    off = {rule[1] for rule in ALERT_RULES if not rule[5]}
    runs = spark.createDataFrame(
        [("f", dt.datetime(2024, 1, d), d, "success", 0.5, n, 10, 0.9, 99.0, "postgresql") for d, n in ((1, 1000), (2, 10))],
        "pipeline_name string, started_at timestamp_ntz, run_no long, status string, null_rate double, records_loaded long, "
        "duration_seconds int, confidence double, daily_cost double, kind string")
    last = spark.createDataFrame([], "pipeline_name string, condition string, last_fired_at timestamp_ntz")
    now = F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz")
    fired = {r.condition for r in an.alerts(runs, now, last).collect()}
    every = {r.condition for r in an.alerts(runs, now, last, rules=[(*r[:5], True) for r in ALERT_RULES]).collect()}
    assert off and off <= every and fired == every - off


def test_stored_profile_reads_new_files_only(spark, tmp_path):
    from tidemill.operators import profile_store as ps

    path, store = str(tmp_path / "t"), str(tmp_path / "sketches")
    make = lambda a, b: spark.range(a, b).selectExpr("id", "id % 10 AS `k k`", "IF(id % 4 = 0, NULL, id / 2.0D) AS x", "CAST(NULL AS DOUBLE) AS none",
                                                     "concat('v', id % 300) AS s").repartition(2).write.mode("append").parquet(path)
    make(0, 4000)
    assert ps.refresh(spark, path, store) == 2 and ps.refresh(spark, path, store) == 0
    make(4000, 10_000)
    assert ps.refresh(spark, path, store) == 2
    got = {r.column_name: r for r in ps.merged(spark.read.parquet(store)).collect()}
    assert {c: (r.row_count, r.null_pct) for c, r in got.items()} == {
        "id": (10_000, 0.0), "k k": (10_000, 0.0), "x": (10_000, 25.0), "none": (10_000, 100.0), "s": (10_000, 0.0)}
    assert abs(got["id"].distinct_count - 10_000) < 500 and got["k k"].distinct_count == 10 and abs(got["s"].distinct_count - 300) < 15
    assert (got["id"].min_value, got["id"].max_value) == (0.0, 9999.0) and abs(got["id"].median - 5000) < 300
    assert got["none"].distinct_count == 0 and got["none"].median is None and got["s"].median is None
