"""Scans and landing helpers: files, JDBC, incremental extracts, column mapping, catalog listing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.constants import WRITE_WORDS

FORMATS = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}


def detect_format(path: str, file_format: str | None = None) -> str:
    """Explicit format, else the extension without its ?query, else CSV."""
    if file_format:
        return FORMATS.get(file_format.lower(), "csv")
    extension = path.split("?")[0].rsplit(".", 1)[-1].lower()
    return FORMATS.get(extension, "csv")


def read_file(
    spark: SparkSession, path: str, file_format: str | None = None, schema=None, sep: str = ",",
) -> DataFrame:
    """Scan a file, folder, glob or object-store path (s3a://bucket/key).

    CSV without a schema is typed by a pass over the file; give a schema for large inputs.
    """
    fmt = detect_format(path, file_format)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.csv(path, header=True, sep=sep, inferSchema=schema is None)
    return reader.format(fmt).load(path)


def object_path(bucket: str, key: str, scheme: str = "s3a") -> str:
    """The address of an object; a local file has no bucket."""
    return f"{scheme}://{bucket}/{key.lstrip('/')}"


def read_object(spark: SparkSession, bucket: str, key: str, scheme: str = "s3a", file_format: str | None = None, schema=None,
                settings: dict[str, str] | None = None) -> DataFrame:
    """Scan an object (or all below a key) of a bucket, in any store that the session's Hadoop has a client for.

    ``settings`` are that client's for this bucket (endpoint, credentials), as in ``fs.s3a.bucket.<bucket>.<name>``; for
    other schemes they are full names.
    """
    conf = spark._jsc.hadoopConfiguration()
    for name, value in (settings or {}).items():
        conf.set(f"fs.s3a.bucket.{bucket}.{name}" if scheme == "s3a" else name, value)
    return read_file(spark, object_path(bucket, key, scheme), file_format, schema)


def read_jdbc(
    spark: SparkSession, url: str, table: str | None = None, sql: str | None = None, *,
    partition_column: str | None = None, lower: str | None = None, upper: str | None = None,
    partitions: int = 64, fetch_size: int = 10_000, **options: str,
) -> DataFrame:
    """Relational extract, full or by SELECT; split over ``partition_column`` ranges when given."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    if sql:
        reader = reader.option("dbtable", f"({sql}) q") if partition_column else reader.option("query", sql)
    else:
        reader = reader.option("dbtable", table)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores when its files give fewer tasks than there are cores.

    For a scan (or projection of one) that feeds CPU-heavy work. A table in a few small files would
    run in a few tasks; a large table already has enough and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def row_cap(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows in a total order."""
    return df.orderBy(*order).limit(n)


def file_counts(spark: SparkSession, pattern: str, file_format: str | None = None, schema=None) -> DataFrame:
    """Row count per file of a glob. CSV is read as lines of text fields, without type inference."""
    fmt = detect_format(pattern, file_format)
    df = spark.read.csv(pattern, header=True) if fmt == "csv" and schema is None else read_file(spark, pattern, fmt, schema)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def since(df: DataFrame, cursor: str, last) -> DataFrame:
    """Rows strictly after the last seen cursor value; null means everything. The filter reaches the scan."""
    if last is None:
        return df
    return df.filter(F.col(cursor) > (last if isinstance(last, Column) else F.lit(last)))


def select_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run a caller's SELECT over the given tables; statements with write words are refused."""
    if re.search(r"\b(" + "|".join(WRITE_WORDS) + r")\b", sql, re.I):
        raise ValueError("only read statements are allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def map_aliases(df: DataFrame, spec: list[tuple[str, list[str], str | None, object]]) -> DataFrame:
    """For each (target, candidate names, type, default): first candidate present, else the default."""
    present = {c.lower(): c for c in df.columns}
    out = []
    for target, candidates, type_name, default in spec:
        found = next((present[c] for c in candidates if c in present), None)
        c = F.col(found) if found else F.lit(default)
        out.append((c.try_cast(type_name) if type_name else c).alias(target))
    return df.select(*out)


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names upper-cased with spaces as underscores."""
    return df.toDF(*[c.upper().replace(" ", "_") for c in df.columns])


def with_lineage_columns(df: DataFrame, source: str, run_id: str, ingested_at: Column) -> DataFrame:
    return df.withColumns(
        {"_SOURCE": F.lit(source), "_INGESTED_AT": ingested_at, "_RUN_ID": F.lit(run_id)}
    )


def catalog_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_count, row_count) for each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("column_count"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def describe_columns(columns: DataFrame, notes: DataFrame) -> DataFrame:
    """Column catalog left-joined to a registry of descriptions and example values."""
    return columns.join(notes, "column_name", "left").select(
        "table_schema", "table_name", "column_name", "data_type",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("example", F.lit("")).alias("example"),
    )


def sample_rows(df: DataFrame, order: list, n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)
