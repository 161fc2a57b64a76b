"""Column helpers shared by every operator.

Money and durations are decimals, so sums are exact in any order; ratios are
computed in double and rounded through decimal(38,6), half away from zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rnd(c: Column, digits: int) -> Column:
    """Round half away from zero on a decimal, returned as double."""
    return F.round(c.cast("decimal(38,6)"), digits).cast("double")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def dbl(c: Column) -> Column:
    return c.cast("double")


def safe_divide(num: Column, den: Column) -> Column:
    """num / den in double; null when the denominator is 0 or null."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def ratio_sum(num: Column, den: Column | None = None) -> Column:
    """Exact-sum average: sum(num) / count(num), or sum(num) / sum(den)."""
    return safe_divide(F.sum(num), F.count(num) if den is None else F.sum(den))


def cents_to_dollars(c: Column) -> Column:
    return dbl(c) / F.lit(100.0)


def not_empty_string(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def share_pct(cond: Column, digits: int = 1) -> Column:
    """Percentage of rows for which ``cond`` holds."""
    return rnd(F.lit(100.0) * safe_divide(F.count_if(cond), F.count(F.lit(1))), digits)


def day(c: Column) -> Column:
    return F.to_date(c)


def month_start(c: Column) -> Column:
    return F.trunc(F.to_date(c), "month")


def dow(c: Column) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(c) - 1


def seconds_between(start: Column, end: Column) -> Column:
    """end - start in seconds as an exact decimal."""
    return (
        F.timestamp_diff("MICROSECOND", start, end).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    ).cast("decimal(20,6)")


def back(as_of: Column, amount: str) -> Column:
    """as_of minus an interval such as '7 days'."""
    n, unit = amount.split()
    return as_of - F.expr(f"INTERVAL '{n}' {unit.rstrip('s').upper()}")


def decode(c: Column, mapping: dict, default=None) -> Column:
    """Fixed-value lookup evaluated inside codegen."""
    out = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), mapping.items(), F.when(F.lit(False), None))
    return out.otherwise(F.lit(default))


def pick(values: list, index: Column) -> Column:
    """values[index] for a zero-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is_numeric(f.dataType.simpleString())]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")]


def _is_numeric(type_name: str) -> bool:
    return type_name in ("tinyint", "smallint", "int", "bigint", "float", "double") or type_name.startswith("decimal")


def date_spine(spark, start: Column, end: Column, name: str = "date_day") -> DataFrame:
    """One row per day from start to end inclusive."""
    return spark.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias(name))
