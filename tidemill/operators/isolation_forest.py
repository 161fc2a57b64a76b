"""Isolation forest: trees grown in parallel on small samples, rows scored where they are.

Every tree draws its subsample from all rows by hashes of row and draw, in one pass for all trees, so a
forest is reproducible. The grown forest has at most TREES * 2 * SUBSAMPLE nodes and travels to the
tasks as arrays.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.ordered import exact_percentiles
from tidemill.session import cut_lineage

# Task code travels with its functions, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, SUBSAMPLE = 200, 256
CONTAMINATION = 0.08
_NODES = "tree int, rows int, node int, feature int, threshold double, child int, path double"
EULER = 0.5772156649015329


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass(frozen=True)
class Forest:
    columns: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    sample: int
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """-2^(-E(path)/c): near -1 for outliers, near 0 for dense rows."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, self.child[at] + right, at)
            total += self.path[at]
        return -np.power(2.0, -total / (len(self.roots) * float(average_path(self.sample))))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, float]]:
    """Nodes (feature or -1, threshold, left child, path length); children are adjacent."""
    nodes = [(-1, 0.0, -1, 0.0)]
    todo = [(0, x, 0)]
    while todo:
        at, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes[at] = (-1, 0.0, -1, depth + float(average_path(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        right = rows[:, f] > cut
        left_child = len(nodes)
        nodes += [(-1, 0.0, -1, 0.0)] * 2
        nodes[at] = (f, cut, left_child, 0.0)
        todo += [(left_child, rows[~right], depth + 1), (left_child + 1, rows[right], depth + 1)]
    return nodes


def draw(df: DataFrame, key: str, trees: int, subsample: int, seed: int) -> DataFrame:
    """``df`` with ``tree``: ``subsample`` rows for each tree, or all rows where there are no more.

    A row takes part in as many draws as it takes for twice the wanted number; each picks a tree by hash. So what is
    shuffled is about twice the samples, whatever the size of ``df``.
    """
    n = df.count()
    wanted = 2 * trees * subsample
    if n <= 2 * subsample:
        drawn = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    else:
        per_row = -(-wanted // n)
        share = F.pmod(F.xxhash64(key, "_draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        drawn = df.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1)))) \
            .filter(share < wanted / (n * per_row)) \
            .withColumn("tree", F.pmod(F.xxhash64(F.lit(seed), "_draw", key), F.lit(trees)).cast("int")) \
            .dropDuplicates([key, "tree"]).drop("_draw")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.xxhash64(key, "tree", F.lit(seed)), key))
    return drawn.withColumn("_rn", rank).filter(F.col("_rn") <= subsample).drop("_rn")


def fit(df: DataFrame, columns: list[str], key: str, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42) -> Forest:
    samples = draw(df.select(key, *columns), key, trees, subsample, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        tree = int(pdf["tree"].iloc[0])
        limit = max(1, math.ceil(math.log2(max(len(pdf), 2))))
        nodes = _grow(pdf[columns].to_numpy(dtype=float), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "child", "path"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "rows", len(pdf))
        out.insert(0, "tree", tree)
        return out

    grown = samples.groupBy("tree").applyInPandas(grow, _NODES).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    roots = np.flatnonzero(grown["node"].to_numpy() == 0)
    start = roots[np.cumsum(grown["node"].to_numpy() == 0) - 1]
    child = np.where(grown["child"] >= 0, grown["child"] + start, 0)
    size = int(grown["rows"].max())
    return Forest(columns, grown["feature"].to_numpy(), grown["threshold"].to_numpy(), child, grown["path"].to_numpy(),
                  roots, size, max(1, math.ceil(math.log2(max(size, 2)))))


def score(forest: Forest, df: DataFrame, key: str) -> DataFrame:
    """(key, raw_score) for every row."""
    columns = forest.columns
    key_type = dict(df.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b.column(c), dtype=float) for c in columns]) if b.num_rows else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(forest.scores(x))], names=[key, "raw_score"])

    return df.select(key, *[F.col(c).cast("double") for c in columns]).mapInArrow(scan, f"{key} {key_type}, raw_score double")


def decide(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Decision value: below 0 for the ``contamination`` share with the lowest raw scores.

    The scores are written to the shared folder first: the quantile reads them twice more, and
    scoring is the costly part.
    """
    scored = cut_lineage(scored, "scores")
    offset = exact_percentiles(scored, [], "raw_score", {"o": contamination}).select("o").scalar()
    return scored.withColumn("decision", F.col("raw_score") - offset).withColumn("is_outlier", F.col("decision") < 0)
