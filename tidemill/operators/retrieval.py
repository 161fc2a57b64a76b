"""Exact nearest-neighbour retrieval by cosine distance with a metadata filter.

Each task multiplies its vectors, a slice at a time, with the query matrix and keeps the k nearest per query
until its end, so what is shuffled is k rows per query and task. A query set above ``MAX_QUERIES`` is not gathered:
queries and store are cut into blocks that meet pairwise inside Spark.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Task code travels with its functions, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 3
MAX_DISTANCE = 0.35
REUSE_SIMILARITY = 0.90
MAX_QUERIES = 4096
BLOCK_ROWS = 200_000
CELLS = 1 << 21

_OUT = "query_id bigint, item_id bigint, distance double"


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal-length vectors as unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class Nearest:
    """The k nearest accepted items of each query so far, ties by item id. A null query tag matches every item."""

    def __init__(self, ids: list[int], queries: np.ndarray, tags: np.ndarray, k: int, max_distance: float):
        self.ids, self.queries, self.tags, self.k, self.max_distance = ids, queries, tags, k, max_distance
        self.held = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def add(self, item_ids: np.ndarray, items: np.ndarray, item_tags: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(self.ids)))
        for a in range(0, len(item_ids) if self.ids else 0, step):
            part = slice(a, a + step)
            distance, tags, ids = 1.0 - items[part] @ self.queries.T, item_tags[part], item_ids[part]
            for j, (best, near) in enumerate(self.held):
                ok = distance[:, j] <= self.max_distance
                if self.tags[j] is not None:
                    ok &= tags == self.tags[j]
                if ok.any():
                    best, near = np.concatenate([best, ids[ok]]), np.concatenate([near, distance[ok, j]])
                    first = np.lexsort((best, np.round(near, 9)))[:self.k]
                    self.held[j] = best[first], near[first]

    def rows(self) -> pa.RecordBatch:
        n = [len(best) for best, _ in self.held]
        empty = [np.zeros(0)]
        return pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.repeat(np.array(self.ids, np.int64), n), pa.int64()),
            "item_id": pa.array(np.concatenate([b for b, _ in self.held] or empty).astype(np.int64), pa.int64()),
            "distance": pa.array(np.concatenate([d for _, d in self.held] or empty), pa.float64())})


def _tags(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def recall(queries: DataFrame, store: DataFrame, k: int = TOP_K, max_distance: float = MAX_DISTANCE,
           max_queries: int = MAX_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, item_id, distance, rank) of the k nearest store items within max_distance.

    ``queries`` (query_id, embedding, tag) and ``store`` (item_id, embedding, tag): a query with a tag
    only meets items with the same tag. Null and empty vectors are near nothing. Items whose column ``deprecated``, if
    the store has one, is true are left out.
    """
    if "deprecated" in store.columns:
        store = store.filter(~F.coalesce("deprecated", F.lit(False)))
    queries, store = (x.filter(F.size("embedding") > 0) for x in (queries, store))
    queries = queries.select(F.col("query_id").cast("bigint"), "embedding", F.col("tag").cast("string"))
    store = store.select(F.col("item_id").cast("bigint"), "embedding", F.col("tag").cast("string"))
    n_queries = queries.count()
    if n_queries <= max_queries:
        near = _by_broadcast(queries, store, k, max_distance)
    else:
        near = _by_blocks(queries, store, k, max_distance, math.ceil(n_queries / max_queries), block_rows)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("distance", 9), "item_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def _by_broadcast(queries: DataFrame, store: DataFrame, k: int, max_distance: float) -> DataFrame:
    table = queries.toArrow()
    ids, matrix, tags = table["query_id"].to_pylist(), _matrix(table["embedding"]), _tags(table["tag"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(ids, matrix, tags, k, max_distance)
        for b in batches:
            best.add(np.asarray(b.column("item_id")), _matrix(b.column("embedding")), _tags(b.column("tag")))
        yield best.rows()

    return store.mapInArrow(scan, _OUT)


def _by_blocks(queries: DataFrame, store: DataFrame, k: int, max_distance: float, q_blocks: int, block_rows: int) -> DataFrame:
    s_blocks = max(1, math.ceil(store.count() / block_rows))

    def blocks(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("sb", blocks(s_blocks))
    s = store.withColumn("sb", F.pmod(F.xxhash64("item_id"), F.lit(s_blocks)).cast("int")).withColumn("qb", blocks(q_blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Nearest(left["query_id"].to_pylist(), _matrix(left["embedding"]), _tags(left["tag"]), k, max_distance)
        best.add(np.asarray(right["item_id"]), _matrix(right["embedding"]), _tags(right["tag"]))
        return pa.Table.from_batches([best.rows()])

    return q.groupBy("qb", "sb").cogroup(s.groupBy("qb", "sb")).applyInArrow(meet, _OUT)


def similar_queries(neighbours: DataFrame, quality: DataFrame) -> DataFrame:
    """Neighbours with similarity and the item's quality, best quality first within a query."""
    order = W.partitionBy("query_id").orderBy(F.desc("quality_score"), "item_id")
    return neighbours.join(quality, "item_id").select(
        "query_id", "item_id", F.round((1 - F.col("distance")).cast("decimal(38,6)"), 3).cast("double").alias("similarity"),
        "quality_score").withColumn("position", F.row_number().over(order))


def reusable(neighbours: DataFrame, min_similarity: float = REUSE_SIMILARITY) -> DataFrame:
    """Best neighbours that are close enough to reuse their fix as is."""
    return neighbours.filter((F.col("rank") == 1) & (1 - F.col("distance") >= min_similarity))
