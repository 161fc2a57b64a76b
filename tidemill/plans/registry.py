"""Registry of named queries: each has a Spark builder and, where possible, a check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.oracle import with_tables
from tidemill.sources.bindings import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_types(self.build(Tables(spark, sf_dir)))


def plain_types(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as double, the form in which results are compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "date":
            c = c.cast("string").alias(f.name)
        elif f.dataType.typeName() == "decimal":
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``build(tables) -> DataFrame`` under ``name``; ``uses`` lists derived tables the SQL reads."""
    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = with_tables(uses.split(), sql) if sql else None
        QUERIES[name] = Query(name, build, text)
        return build

    return add
