"""Ranked lexical search by ball trees over sparse document vectors: exact integer scores, bounds by centroid and radius.

A document's score for an item is an inner product: the item counts and weighs its terms (q), the document holds their
saturated frequencies (x). Each task takes its documents into trees of bounded size. A node knows a
centroid c of its documents and a radius R, the largest distance of one of them from c, so

    q . x = q . c + q . (x - c) <= q . c + |q| R

holds for every document below it, with |q| over the terms that occur below the node. Nodes are opened best bound first;
one whose bound is below the tenth best score so far is left with all that is under it. Leaves are scored in 64-bit
integers. Radius and bound are worked out in doubles and rounded up by more than their largest possible error, so no
document that belongs to the answer is ever pruned.

The items come in blocks of at most ``TERMS`` different (item, term) pairs, or of one item; a block is what the driver
holds and broadcasts. For each block one pass over the texts writes the documents' vectors over the block's terms (words
are found by hash and verified byte by byte), one pass over these counts document frequencies, and one searches. A task
hands on at most k documents an item, so what is shuffled does not grow with the corpus but with tasks x items.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import table
from tidemill.llm.words import ALNUM, Words, row_ranges, text_buffer
from tidemill.session import cut_lineage, discard, scratch_path

TERMS = 1 << 21
BEST = 10
LEAF = 64
#: Documents and entries of one tree.
TREE, ENTRIES = 8192, 1 << 22
#: Relative error of any sum of up to a few million products in doubles, with room.
SLACK = 1e-9
NO_ID = (1 << 63) - 1
VECTOR = "doc bigint, n bigint, cols array<int>, tfs array<int>"


class Terms:
    """Sorted hashes of some terms, and their bytes to tell them from other words of the same hash."""

    def __init__(self, terms: list[bytes]):
        text = pa.array([t.decode() for t in terms], pa.large_string())
        words = Words(*text_buffer(text), ALNUM) if terms else None
        hashes = words.hashes if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        if len(self.hashes) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ArithmeticError("two terms of one block of items share a 64-bit hash; take other blocks")
        self.place = order.astype(np.int32)
        lengths = np.array([len(t) for t in terms], np.int64)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.data = np.frombuffer(b"".join(terms), np.uint8)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and these terms."""
        if not len(self.hashes) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == words.hashes)
        term = self.place[at[hit]]
        same = words.ends[hit] - words.starts[hit] == self.lengths[term]
        hit, term = hit[same], term[same]
        n = self.lengths[term]
        if len(hit):
            ends = np.cumsum(n)
            inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
            differ = words.data[np.repeat(words.starts[hit], n) + inside] != self.data[np.repeat(self.starts[term], n) + inside]
            same = np.add.reduceat(differ, ends - n) == 0
            hit, term = hit[same], term[same]
        return hit, term


def _vectors(batches, terms):
    """Per document the number of its words, and term numbers with frequencies over the block's terms."""
    known: Terms = terms.value
    size = max(1, len(known.hashes))
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in row_ranges(offsets):
            words = Words(data, offsets[a:b + 1], ALNUM)
            hit, term = known.find(words)
            keys, tfs = np.unique(words.rows[hit] * size + term, return_counts=True)
            ends = np.searchsorted(keys, np.arange(b - a + 1) * size)
            lists = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(words.bounds), pa.int64()),
                 lists((keys % size).astype(np.int32)), lists(tfs.astype(np.int32))], ["doc", "n", "cols", "tfs"])


def _frequencies(batches, size: int):
    """How many documents of the task hold each term."""
    counts = np.zeros(size, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], ["col", "df"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 8 m), with m = 25 + (75 n N) div L; all 64-bit."""
    if len(n) and int(n.max()) * 75 * n_docs >= 1 << 63:
        n = n.astype(object)
    m = (25 + 75 * n * n_docs // n_words).astype(np.int64)
    return 10 ** 9 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


class BallTree:
    """A balanced tree over sparse rows (``indptr``, ``cols``, ``vals`` of integers), none of which is empty."""

    def __init__(self, indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, leaf: int = LEAF):
        self.indptr, self.cols, self.vals = indptr, cols, vals
        self.order = np.arange(len(indptr) - 1)
        self.nodes: list[tuple[int, int, int, float, np.ndarray, np.ndarray]] = []
        self._places, self._local = np.unique(cols, return_inverse=True)
        self._x = vals.astype(np.float64)
        self._squares = self._rowsum(self._x * self._x, indptr)
        self._grow(leaf)
        self.indptr, self.cols, self.vals, *_ = self._taken(self.order)
        del self._local, self._x, self._squares

    @staticmethod
    def _rowsum(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
        """Sums over rows."""
        return np.add.reduceat(values, indptr[:-1])

    def _taken(self, rows: np.ndarray):
        n = np.diff(self.indptr)[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.indptr[rows] - (ends - n), n) + np.arange(ends[-1])
        return np.concatenate([[0], ends]), self.cols[at], self.vals[at], self._local[at], self._x[at]

    def _grow(self, leaf: int) -> None:
        """Nodes are (first row, end, left child or -1, radius, columns of the centroid, centroid); right = left + 1."""
        self.nodes.append((0, len(self.order), -1, 0.0, None, None))
        todo = [0]
        while todo:
            node = todo.pop()
            a, b, *_ = self.nodes[node]
            rows = self.order[a:b]
            indptr, _, _, local, x = self._taken(rows)
            total = np.bincount(local, x, len(self._places))
            held = np.flatnonzero(total)
            center = total / len(rows)
            squares, size = self._squares[rows], float(center[held] @ center[held])
            dots = self._rowsum(x * center[local], indptr)
            error = SLACK * (squares + 2 * dots + size)
            far = squares - 2 * dots + size
            radius = math.sqrt(max(0.0, float((far + error).max()))) * (1 + SLACK)
            left = -1
            if len(rows) > leaf:
                one = int(far.argmax())
                line = np.zeros(len(center))
                line[local[indptr[one]:indptr[one + 1]]] = x[indptr[one]:indptr[one + 1]]
                away = squares - 2 * self._rowsum(x * line[local], indptr)
                other = int(away.argmax())
                line[local[indptr[other]:indptr[other + 1]]] -= x[indptr[other]:indptr[other + 1]]
                half = len(rows) // 2
                self.order[a:b] = rows[np.argsort(self._rowsum(x * line[local], indptr), kind="stable")]
                left = len(self.nodes)
                self.nodes += [(a, a + half, -1, 0.0, None, None), (a + half, b, -1, 0.0, None, None)]
                todo += [left, left + 1]
            self.nodes[node] = a, b, left, radius, self._places[held], center[held]

    def bound(self, node: int, query: np.ndarray, squares: np.ndarray) -> float:
        """No row below ``node`` has a larger inner product with ``query`` (``squares``: its squares)."""
        _, _, _, radius, cols, center = self.nodes[node]
        return (float(query[cols] @ center) + math.sqrt(float(squares[cols].sum())) * radius) * (1 + SLACK) + 1

    def search(self, exact: np.ndarray, ids: list[int], best: list[tuple[int, int]], k: int) -> int:
        """Put the rows with the largest products with ``exact`` (an integer per column) into the heap ``best`` of at most k
        (score, -id), products below 1 left out; return how many rows were scored."""
        query, scored = exact.astype(np.float64), 0
        squares = query * query
        todo = [(-self.bound(0, query, squares), 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < (best[0][0] if len(best) == k else 1):
                break
            a, b, left, *_ = self.nodes[node]
            if left >= 0:
                for child in (left, left + 1):
                    value = min(-bound, self.bound(child, query, squares))
                    heapq.heappush(todo, (-value, child))
                continue
            scored += b - a
            lo, hi = self.indptr[a], self.indptr[b]
            scores = np.add.reduceat(exact[self.cols[lo:hi]] * self.vals[lo:hi], self.indptr[a:b] - lo)
            for i in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
                entry = int(scores[i]), -ids[self.order[a + i]]
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


@dataclass(frozen=True)
class Block:
    """Items with their term numbers and counts, and the terms themselves."""

    numbers: list[int]
    terms: list[bytes]
    wanted: list[tuple[np.ndarray, np.ndarray]]


def _trees(batches, weights, n_docs: int, n_words: int) -> Iterator[tuple[BallTree, list[int]]]:
    """Trees over the documents of a task; terms of weight 0 change no score and are left out."""
    def grown(rows):
        ids = [x for r in rows for x in r[0]]
        lengths, cols, vals = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
        return BallTree(np.concatenate([[0], np.cumsum(lengths)]), cols, vals), ids

    held, docs, entries = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            n = np.asarray(part.column(2).value_lengths())
            cols, tfs = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            vals = saturated(tfs, np.repeat(part.column(1).to_numpy(), n), n_docs, n_words)
            keep = (weights[cols] > 0) & (vals > 0)
            lengths = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
            rows = np.flatnonzero(lengths)
            if not len(rows):
                continue
            ids = [NO_ID if x is None else x for x in part.column(0).to_pylist()]
            held.append(([ids[i] for i in rows], lengths[rows], cols[keep], vals[keep]))
            docs, entries = docs + len(rows), entries + len(held[-1][2])
            if docs >= TREE or entries >= ENTRIES:
                yield grown(held)
                held, docs, entries = [], 0, 0
    if held:
        yield grown(held)


def _searched(batches, block, weights, n_docs: int, n_words: int, k: int):
    items, weights = block.value, weights.value
    best: list[list[tuple[int, int]]] = [[] for _ in items.wanted]
    exact = np.zeros(len(weights), np.int64)
    for tree, ids in _trees(batches, weights, n_docs, n_words):
        for heap, (cols, counts) in zip(best, items.wanted, strict=True):
            exact[cols] = counts * weights[cols]
            tree.search(exact, ids, heap, k)
            exact[cols] = 0
    rows = [(i, -d, s) for i, heap in zip(items.numbers, best, strict=True) for s, d in heap]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(
        [None if r[1] == NO_ID else r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
        ["item", "doc", "score"])


def _terms_of(text: str) -> dict[bytes, int]:
    words = Words(*text_buffer(pa.array([text], pa.large_string())), ALNUM)
    out: dict[bytes, int] = {}
    for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True):
        term = words.data[a:b].tobytes()
        out[term] = out.get(term, 0) + 1
    return out


def _counted(batches):
    for batch in batches:
        rows = [_terms_of(t) if t else {} for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([list(r) for r in rows], pa.list_(pa.binary())),
             pa.array([list(r.values()) for r in rows], pa.list_(pa.int64()))], ["item", "terms", "counts"])


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The items with terms, in blocks of at most ``TERMS`` pairs or of one item."""
    numbers, wanted, known = [], [], {}
    held = 0
    for r in items.toLocalIterator():
        if held and held + len(r.terms) > TERMS:
            yield Block(numbers, list(known), wanted)
            numbers, wanted, known, held = [], [], {}, 0
        cols = np.array([known.setdefault(bytes(t), len(known)) for t in r.terms], np.int32)
        numbers.append(r.item)
        wanted.append((cols, np.array(r.counts, np.int64)))
        held += len(r.terms)
    if numbers:
        yield Block(numbers, list(known), wanted)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           k: int = BEST) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each row of ``items``: item id, ``rank`` (int, from 1), document id,
    ``score`` (long); equal scores by ascending document id, null ids last.

    Null texts have no terms; an item without terms, or without a document that shares one, has no rows; repeated items
    are ranked each for itself; empty tables give an empty result. Other columns do not matter. Ids of documents are
    64-bit integers.
    """
    spark = docs.sparkSession
    numbered = cut_lineage(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("id"),
                                        F.col(f"`{text}`").alias("text")), "items")
    counted = cut_lineage(numbered.select("item", "text").mapInArrow(_counted, "item bigint, terms array<binary>, counts array<bigint>")
                          .filter(F.size("terms") > 0), "terms")
    corpus = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    out = scratch_path(spark, "ranked")
    spark.createDataFrame([], "item bigint, doc bigint, score bigint, rank int").write.parquet(out)
    for block in _blocks(counted):
        terms = spark.sparkContext.broadcast(Terms(block.terms))
        path = scratch_path(spark, "vectors")
        corpus.mapInArrow(partial(_vectors, terms=terms), VECTOR).write.parquet(path)
        vectors = spark.read.schema(VECTOR).parquet(path)
        n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = vectors.select("cols").mapInArrow(partial(_frequencies, size=len(block.terms)), "col int, df bigint") \
            .groupBy("col").agg(F.sum("df").alias("df")).collect()
        weights = np.zeros(len(block.terms), np.int64)
        for r in held:
            weights[r.col] = weight(n_docs, r.df)
        sent = spark.sparkContext.broadcast(block), spark.sparkContext.broadcast(weights)
        found = vectors.filter(F.size("cols") > 0).mapInArrow(partial(
            _searched, block=sent[0], weights=sent[1], n_docs=n_docs, n_words=n_words, k=k), "item bigint, doc bigint, score bigint")
        _ranked(found, k).write.mode("append").parquet(out)
        discard(spark, path)
        for x in (terms, *sent):
            x.unpersist()
    ranked = spark.read.schema("item bigint, doc bigint, score bigint, rank int").parquet(out)
    return numbered.select("item", F.col("id").alias(item_id)).join(ranked, "item") \
        .select(item_id, "rank", F.col("doc").alias(doc_id), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item its 10 highest-scoring documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
