"""Validation of a repaired table: structure, null rate, copies, idempotency, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import rnd, safe_divide
from tidemill.operators.quality import schema_drift
from tidemill.operators.remediate import verify
from tidemill.session import cut_lineage

MAX_NULL_RATE = 0.20
ROW_TOLERANCE = 0.01


def same_size(first: Column, second: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """Row counts within the tolerance; 0 only equals 0."""
    return F.when(first == 0, second == 0).otherwise(F.abs(first - second) / first <= tolerance)


def confidence(passed: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.least(F.lit(1.0), safe_divide(passed, total)))


def schema_of(df: DataFrame) -> DataFrame:
    rows = [("t", f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or retyped by a repair."""
    events = schema_drift(schema_of(before), schema_of(after))
    return events.filter(F.col("event_type") != "constraint_changed").drop("table_name")


def validate(before: DataFrame, fix: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(check, passed, value) for ``fix``: applied once, and again to its own output.

    The repaired table is written once; every measure reads that.
    """
    once = cut_lineage(fix(before), "repaired")
    twice = fix(once)
    again = twice.agg(F.count("*")).scalar()
    changed = schema_changes(before, once).agg(F.count("*")).scalar()
    m = verify(once).withColumns({"again": again, "changed": changed})
    copies = F.coalesce(safe_divide(F.col("copies"), F.col("rows")), F.lit(0.0))

    def check(name: str, passed: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), rnd(value, 4).alias("value"))

    return m.select(F.inline(F.array(
        check("output_has_columns", F.col("columns") > 0, F.col("columns")),
        check("output_has_rows", F.col("rows") > 0, F.col("rows")),
        check("low_null_rate", F.col("mean_null_share") < MAX_NULL_RATE, F.col("mean_null_share")),
        check("no_duplicate_rows", copies == 0, copies),
        check("idempotent", same_size(F.col("rows"), F.col("again")), F.col("again")),
        check("schema_preserved", F.col("changed") == 0, F.col("changed")),
    )))


def overall(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total")).withColumn(
        "confidence", rnd(confidence(F.col("passed"), F.col("total")), 4))
