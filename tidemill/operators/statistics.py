"""Statistics over experiment tables: description, paired and one-sample t, effect size, learning curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import rnd, safe_divide
from tidemill.functions.ordered import exact_percentiles, join_on, with_running_sum


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, min, max, median and the normal 95 % interval of the mean."""
    v = F.col(value).cast("double")
    basics = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    median = exact_percentiles(df, keys, value, {"median": 0.5})
    half = 1.96 * F.col("s") / F.sqrt("n")
    return join_on(basics, median, keys).select(
        *keys, "n", rnd(F.col("m"), 2).alias("mean"), rnd(F.col("s"), 2).alias("std"), rnd(F.col("lo"), 2).alias("min"),
        rnd(F.col("hi"), 2).alias("max"), rnd(F.col("median"), 2).alias("median"),
        rnd(F.col("m") - half, 2).alias("ci95_low"), rnd(F.col("m") + half, 2).alias("ci95_high"))


def _t(mean: Column, std: Column, n: Column) -> Column:
    return mean / F.nullif(std / F.sqrt(n), F.lit(0.0))


def paired_t(pairs: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """t statistic, degrees of freedom and effect size of x - y per key."""
    d = F.col(x).cast("double") - F.col(y).cast("double")
    stats = pairs.filter(d.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return stats.select(
        *keys, "n", (F.col("n") - 1).alias("df"), rnd(_t(F.col("m"), F.col("s"), F.col("n")), 4).alias("t_statistic"),
        rnd(F.col("m") / F.nullif(F.col("s"), F.lit(0.0)), 4).alias("cohens_d"))


def one_sample_t(df: DataFrame, value: str, constant: float, keys: list[str] = ()) -> DataFrame:
    v = F.col(value).cast("double")
    stats = df.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    return stats.select(*keys, "n", (F.col("n") - 1).alias("df"),
                        rnd(_t(F.col("m") - constant, F.col("s"), F.col("n")), 4).alias("t_statistic"))


def reduction(base: Column, new: Column) -> tuple[Column, Column]:
    """(reduction %, speed-up) of new against base."""
    return rnd(100.0 * safe_divide(base - new, base), 2), rnd(safe_divide(base, new), 2)


def learning_curve(df: DataFrame, keys: list[str], time: str, tie: str, value: str, success: Column, block: int = 5) -> DataFrame:
    """Mean value and success rate per block of consecutive rows of a key."""
    numbered = with_running_sum(df.withColumns({"_one": F.lit(1), "_ok": success.cast("int")}), keys, time, tie, "_one", "_rank")
    return numbered.groupBy(*keys, F.floor((F.col("_rank") - 1) / block).alias("block")).agg(
        F.count("*").alias("n"), rnd(safe_divide(F.sum(value), F.count(value)), 1).alias("mean_value"),
        rnd(safe_divide(F.sum("_ok"), F.count("*")), 3).alias("success_rate"))


def success_by_configuration(df: DataFrame, row: str, configuration: str, configurations: list[str], success: Column) -> DataFrame:
    """Success rate per row value, one column per configuration."""
    return df.groupBy(row).pivot(configuration, configurations).agg(
        rnd(safe_divide(F.count_if(success), F.count(F.lit(1))), 3))
