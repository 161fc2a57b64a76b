"""Every remediation on empty, null-heavy, duplicated and widened input; fixing twice changes nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import remediate as fx

SCHEMA = "id int, amount double, note string, event_time timestamp_ntz"


def heavy(spark):
    rows = [(i, None if i % 2 else float(i), None if i % 3 else f" n{i} ", None if i % 4 == 0 else dt.datetime(2024, 1, 1 + i % 20)) for i in range(50)]
    return spark.createDataFrame(rows, SCHEMA)


def duplicated(spark):
    df = heavy(spark)
    return df.unionByName(df.filter("id < 15"))


def widened(spark):
    return heavy(spark).withColumns({"extra_flag": F.lit(True), "extra_day": F.lit("2024-01-01").cast("date"), "gone": F.lit(None).cast("string")})


AS_OF = dt.datetime(2024, 1, 20)
FIXES = {
    "schema_change": fx.schema_change,
    "data_quality": fx.data_quality,
    "connection": fx.connection,
    "volume": fx.volume,
    "timeout": lambda df: fx.timeout(df, 500_000),
    "logic": fx.logic,
    "rate_limit": lambda df: fx.rate_limit(df, ["id", "amount", "note"]),
    "cdc_lag": lambda df: fx.cdc_lag(df, "id", "event_time"),
    "incremental_sync": lambda df: fx.incremental_sync(df, F.lit(AS_OF).cast("timestamp_ntz"), "id", "event_time"),
    "cascading": fx.cascading,
    "checkpoint": fx.checkpoint,
    "duplicate_spike": lambda df: fx.duplicate_spike(df, ["id"], "event_time"),
    "snowflake_schema": fx.snowflake_schema,
    "bigquery_type": fx.bigquery_type,
    "mysql_cdc": fx.mysql_cdc,
    "mongodb_flatten": fx.mongodb_flatten,
    "redshift_load": fx.redshift_load,
    "partition_skew": lambda df: fx.partition_skew(df.drop("_partition_salt"), "note"),
}


@pytest.mark.parametrize("name", FIXES)
def test_empty_input(name, spark):
    empty = spark.createDataFrame([], SCHEMA)
    if name in ("connection", "volume"):
        with pytest.raises(fx.EmptyInput):
            FIXES[name](empty)
    else:
        assert FIXES[name](empty).count() == 0


@pytest.mark.parametrize("make", [heavy, duplicated, widened])
@pytest.mark.parametrize("name", FIXES)
def test_repairs_and_is_stable(name, make, spark):
    once = FIXES[name](make(spark))
    n = once.count()
    assert n > 0
    if not (name == "data_quality" or (name == "schema_change" and make is widened)):
        assert fx.verified(once, name).first().passed or name in ("schema_change",)
    assert FIXES[name](once).count() == n


def test_every_remedy_has_a_check():
    assert set(fx.PASSES) == set(FIXES)


def test_medians_fill(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0), (4, 7.0)], "id int, x double")
    assert rows(fx.data_quality(df), "x") == [(1.0,), (4.0,), (4.0,), (7.0,)]


def test_latest_event_wins(spark, rows):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (1, "b", dt.datetime(2024, 1, 3)), (1, "c", None), (2, "d", None)],
                               "order_id int, v string, event_time timestamp_ntz")
    assert rows(fx.cdc_lag(df), "order_id", "v") == [(1, "b"), (2, "d")]


def test_key_names_are_not_substrings(spark):
    assert fx.guess_columns(spark.createDataFrame([], "paid int, trip_id int, ts timestamp")) == ("trip_id", "ts")
    assert fx.guess_columns(spark.createDataFrame([], "paid int, total int")) == (None, None)


def test_json_flattening_takes_fields_of_all_rows(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"b": {"c": "x"}}'), (3, None)], "id int, doc string")
    assert fx.snowflake_schema(df).columns == ["id", "doc__a", "doc__b.c"]


def test_salt_spreads_copies_of_one_row(spark):
    df = spark.range(900).select(F.lit("hot").alias("k")).unionByName(spark.range(60).select(F.col("id").cast("string").alias("k")))
    salted = fx.partition_skew(df, "k").groupBy("k", "_partition_salt").count()
    assert salted.filter("k = 'hot'").count() == 8
    assert salted.filter("k <> 'hot' AND _partition_salt <> 0").count() == 0
