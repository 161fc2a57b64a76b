"""Window helpers over aggregated series, and ranks that need no single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.exprs import rnd, safe_divide
from tidemill.functions.ordered import prefix_sum


def share_of_total(df: DataFrame, keys: list[str], value: str, name: str, digits: int = 2) -> DataFrame:
    """Percentage of ``value`` within its partition; ``df`` holds one row per group already."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return df.withColumn(name, rnd(100.0 * safe_divide(F.col(value), total), digits))


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Running sum over a calendar series (one row per key and period)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, name: str, rows: int = 7) -> DataFrame:
    """Mean of the current and the previous rows - 1 periods."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, rnd(safe_divide(F.sum(value).over(w), F.count(value).over(w)), 2))


def with_change(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Previous period's value (0 before the first) and the growth % against it."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(value, 1, 0).over(w)).withColumn(
        "growth_pct", rnd(100.0 * safe_divide(F.col(value) - F.col("previous"), F.col("previous")), 2))


def declining(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below the previous period's."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col(value) < F.col("previous"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group; Spark limits each group before the shuffle."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= n)


def value_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Per distinct value: its rows ``n`` and the SQL rank of those rows by ``value`` descending.

    Rows are counted per value; a value's rank follows from the number of rows up to it, summed slice by slice.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return prefix_sum(counts, [], [F.desc(value)], "n", "_upto").select(value, "n", (F.col("_upto") - F.col("n") + 1).alias(name))


def global_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """SQL rank of every row by ``value`` descending over the whole table; null values rank after all others."""
    ranks = value_ranks(df, value, name).drop("n")
    last = df.agg(F.count(value) + 1).scalar()
    return df.join(ranks, value, "left").withColumn(name, F.coalesce(name, last))


def fill_gaps(spine: DataFrame, series: DataFrame, on: str, value: str) -> DataFrame:
    """Every period of the spine, with 0 where the series has none."""
    return spine.join(series, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))
