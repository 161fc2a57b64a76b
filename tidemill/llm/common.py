"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import discard, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (names compare without case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python worker. Task code travels by value, so its own globals are new in
    each task; a module of the worker's is not."""
    module = sys.modules.setdefault("_tidemill_worker", types.ModuleType("_tidemill_worker"))
    return module.__dict__.setdefault(name, {})


class Steps:
    """Tables of one job in the shared folder; each is removed once what was read from it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as a table, read back."""
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that no unwritten plan reads any more."""
        for out, path in [h for h in self.held if any(h[0] is t for t in tables)]:
            discard(self.spark, path)
        self.held = [h for h in self.held if all(h[0] is not t for t in tables)]

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*(out for out, _ in self.held if all(out is not k for k in kept)))
