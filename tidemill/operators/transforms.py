"""Record transforms of the load path, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rename:
    src: str
    dst: str


@dataclass(frozen=True)
class Drop:
    column: str


@dataclass(frozen=True)
class Cast:
    """Cast with null kept; a value that cannot be cast becomes null and sets ``<column>__cast_failed``."""
    column: str
    type: str


@dataclass(frozen=True)
class AddConstant:
    column: str
    value: object


def cast_value(c: Column, type_name: str, source_type: str = "string") -> Column:
    """integer truncates toward zero through double; boolean is true for true/1/yes or a non-zero number."""
    if type_name == "integer":
        number = c.try_cast("double")
        return F.when(~F.isnan(number), number.try_cast("bigint"))
    if type_name == "float":
        return c.try_cast("double")
    if type_name == "boolean":
        if source_type == "string":
            return F.lower(c).isin("true", "1", "yes")
        return c.cast("double") != 0
    return c.cast("string")


def apply_transforms(df: DataFrame, steps: list) -> DataFrame:
    """Apply steps in order; steps on absent columns do nothing."""
    for step in steps:
        if isinstance(step, Rename):
            df = df.withColumnRenamed(step.src, step.dst)
        elif isinstance(step, Drop):
            df = df.drop(step.column)
        elif isinstance(step, AddConstant):
            df = df.withColumn(step.column, F.lit(step.value))
        elif isinstance(step, Cast) and step.column in df.columns:
            old = F.col(step.column)
            new = cast_value(old, step.type, df.schema[step.column].dataType.simpleString())
            df = df.withColumns({f"{step.column}__cast_failed": old.isNotNull() & new.isNull(), step.column: new})
    return df


_OPS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def apply_mappings(df: DataFrame, mappings: list[dict], filters: list[dict] = ()) -> DataFrame:
    """Declared filters [{field, op, value}] then mappings [{src, dst, type}]."""
    for f in filters:
        df = df.filter(_OPS[f["op"]](F.col(f["field"]), f.get("value")))
    if not mappings:
        return df
    return df.select(*[
        (F.col(m["src"]).try_cast(m["type"]) if m.get("type") else F.col(m["src"])).alias(m["dst"]) for m in mappings
    ])
