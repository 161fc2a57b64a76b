"""Column profiles kept per file as mergeable sketches: a new profile reads new files only.

A file leaves one row per column: row and value counts, smallest and largest number, an HLL sketch of the distinct values
and, for numbers, a KLL sketch of their distribution. Profiles of any set of files, a day or the whole table, are unions of
these rows. With the default sizes the distinct count is off by 1.6 % (one deviation), a quantile's rank by 1.3 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import numeric_columns, rnd, safe_divide

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def sketches(df: DataFrame) -> DataFrame:
    """One row per input file and column, from one aggregate over the table."""
    numbers, types, aggs = set(numeric_columns(df)), dict(df.dtypes), [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        value = F.col(f"`{c}`")
        aggs += [F.count(value).alias(f"f{i}"),
                 F.hll_sketch_agg(value.cast("bigint" if types[c] in INTEGERS else "string")).alias(f"h{i}")]
        if c in numbers:
            x = value.cast("double")
            aggs += [F.kll_sketch_agg_double(x).alias(f"k{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]

    def of(name: str, kind: str, i: int) -> Column:
        return F.col(f"{name}{i}") if df.columns[i] in numbers else F.lit(None).cast(kind)

    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"f{i}").alias("filled"), F.col(f"h{i}").alias("distinct_sketch"),
        of("k", "binary", i).alias("value_sketch"), of("a", "double", i).alias("low"), of("b", "double", i).alias("high"))
        for i, c in enumerate(df.columns)])
    return df.groupBy(F.input_file_name().alias("file")).agg(*aggs).select("file", F.col("n").alias("rows"), F.inline(rows))


def refresh(spark: SparkSession, path: str, store: str) -> int:
    """Add the sketches of the table's files that ``store`` does not know yet; the number of files read."""
    table = spark.read.parquet(path)
    known = set()
    if spark._jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark._jsc.hadoopConfiguration()).exists(
            spark._jvm.org.apache.hadoop.fs.Path(store)):
        known = {r.file for r in spark.read.parquet(store).select("file").distinct().collect()}
    new = sorted(set(table.inputFiles()) - known)  # names of files, of which the driver has a list anyway
    if new:
        sketches(spark.read.schema(table.schema).parquet(*new)).write.mode("append").parquet(store)
    return len(new)


def merged(rows: DataFrame) -> DataFrame:
    """One row per column: rows, null %, distinct count, smallest, median and largest number."""
    filled = F.col("value_sketch").isNotNull() & (F.col("filled") > 0)
    together = rows.groupBy("column_name").agg(
        F.sum("rows").alias("row_count"), F.sum("filled").alias("filled"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
        F.kll_merge_agg_double(F.when(filled, F.col("value_sketch"))).alias("sketch"),
        F.count_if(filled).alias("parts"), F.min("low").alias("min_value"), F.max("high").alias("max_value"))
    median = F.when(F.col("parts") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))
    return together.select(
        "column_name", "row_count", rnd(100.0 * safe_divide(F.col("row_count") - F.col("filled"), F.col("row_count")), 1).alias("null_pct"),
        "distinct_count", "min_value", median.alias("median"), "max_value")
