"""Benchmark decontamination: a broadcast set of benchmark windows, scanned by training windows, each hit verified.

The windows of the benchmark are hashed and grouped by their words in Spark and sent to the tasks in blocks of at most
``BLOCK_BYTES``; a benchmark that needs more than one block is scanned block by block, one block held at a time, and the
hits of equal texts are put together after. A hit of the 64-bit window hash counts only if the words are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import fresh, table, worker_cache
from tidemill.llm.words import ALNUM, Words, row_ranges, text_buffer
from tidemill.session import cut_lineage, scratch_path

WINDOW = 10
BLOCK_BYTES = 32 << 20
FILTER_BITS = 20
RESULTS = ("n_words", "hit_runs", "n_hit", "items", "contaminated")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``length``, ``hash``, ``words`` (lower-cased, one space between), ``items`` (sorted ids as text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in row_ranges(offsets):
                words = Words(data, offsets[a:b + 1], ALNUM)
                out = []
                hashes = {}
                for row in range(b - a):
                    lo, hi = int(words.bounds[row]), int(words.bounds[row + 1])
                    size = min(window, hi - lo)
                    if size:
                        if size not in hashes:
                            at, value = words.windows(size)
                            hashes[size] = dict(zip(at.tolist(), value.view(np.int64).tolist(), strict=True))
                        out += [(size, hashes[size][i], words.joined(i, size), ids[a + row]) for i in range(lo, hi - size + 1)]
                if out:
                    size, value, text, item = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(size, pa.int32()), pa.array(value, pa.int64()), pa.array(text, pa.binary()),
                         pa.array(item, pa.string())], names=["length", "hash", "words", "item"])

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return (rows.mapInArrow(cut, "length int, hash bigint, words binary, item string")
            .groupBy("length", "hash", "words").agg(F.array_sort(F.collect_set("item")).alias("items")))


class WindowSet:
    """A block of benchmark windows, found by hash and confirmed by their words. Their hashes come with them."""

    def __init__(self, rows: list[tuple[int, int, bytes, list[str]]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[bytes, list[str]] = {text: items for _, _, text, items in rows}
        lengths = np.fromiter((r[0] for r in rows), np.int64, len(rows))
        hashes = np.fromiter((r[1] for r in rows), np.int64, len(rows)).view(np.uint64)
        for length in np.unique(lengths).tolist():
            own = np.unique(hashes[lengths == length])
            likely = np.zeros(1 << FILTER_BITS, dtype=bool)
            likely[own >> np.uint64(64 - FILTER_BITS)] = True
            self.by_length[length] = own, likely

    @classmethod
    def of(cls, block) -> WindowSet:
        """The set of a broadcast block, built once in a worker; the block before it goes."""
        held = worker_cache("windows")
        if held.get("of") is not block.value:
            held["of"], held["set"] = block.value, cls(block.value)
        return held["set"]

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of every window of ``words`` that is in the set."""
        for length, (hashes, likely) in self.by_length.items():
            at, found = words.windows(length)
            near = np.flatnonzero(likely[found >> np.uint64(64 - FILTER_BITS)])
            place = np.minimum(np.searchsorted(hashes, found[near]), len(hashes) - 1)
            for first in at[near[hashes[place] == found[near]]].tolist():
                items = self.items.get(words.joined(first, length))
                if items is not None:
                    yield first, length, items


def _blocks(windows: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, int, bytes, list[str]]]]:
    """The windows in lists of bounded size, read partition by partition."""
    block, size = [], 0
    for row in windows.toLocalIterator():
        block.append((row.length, row.hash, bytes(row.words), row["items"]))
        size += len(row.words) + sum(map(len, row["items"])) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(block, text_at: int):
    """A task function: per row its word count, the runs of hit words as byte ranges, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = WindowSet.of(block)
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            for a, b in row_ranges(offsets):
                words = Words(data, offsets[a:b + 1], ALNUM)
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                items: list[set[str]] = [set() for _ in range(b - a)]
                for first, length, names in wanted.hits(words):
                    edges[first] += 1
                    edges[first + length] -= 1
                    items[words.rows[first]].update(names)
                hit = np.cumsum(edges[:-1]) > 0
                n_words = np.diff(words.bounds)
                starts, ends = [], []
                for row in range(b - a):
                    lo, hi = int(words.bounds[row]), int(words.bounds[row + 1])
                    x, y = _runs(hit[lo:hi]) if hit[lo:hi].any() else ((), ())
                    starts.append([int(i) for i in x])
                    ends.append([int(i) for i in y])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(n_words, pa.int64()),
                     pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*batch.schema.names, "w", "a", "b", "i"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         names: tuple[str, ...] = RESULTS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_runs`` (word ranges, end exclusive), ``n_hit``, ``items`` and ``contaminated``.

    Null and empty texts have no words and no hits; repeated rows are scanned alike; an empty benchmark, or an item
    without words, hits nothing; repeated item ids count once and a null id is not listed (its words still count as
    hit). Columns of ``docs`` that have the name of a result give way to it.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    as_words, as_runs, as_hit, as_items, as_found = names
    columns = [F.col(f"`{c}`") for c in docs.columns]
    schema = T.StructType([*docs.schema.fields, T.StructField("w", T.LongType()),
                           *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in "ab"),
                           T.StructField("i", T.ArrayType(T.StringType()))])
    own = [fresh(x, docs.columns) for x in "wabi"]
    for field, name in zip(schema.fields[-4:], own, strict=True):
        field.name = name
    def scanned(rows: DataFrame, block, fields: T.StructType) -> DataFrame:
        return rows.mapInArrow(_renamed(_scan(block, [c.lower() for c in rows.columns].index("text")), fields.fieldNames()), fields)

    send = spark.sparkContext.broadcast
    blocks = _blocks(benchmark_windows(benchmark, window), block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    w, a, b, i = (F.col(f"`{x}`") for x in own)
    runs = F.arrays_zip(a.alias("start"), b.alias("end"))
    if second is None:
        out = scanned(docs, send(first), schema).select(*columns, w.alias(as_words), runs.alias(as_runs), i.alias(as_items))
    else:
        # One pass per block, of which one at a time is held and sent. Equal texts have equal hits, so the hits of the
        # blocks meet by a 128-bit hash of the text, whatever order a recomputed input has.
        slim = docs.select(F.col("text").cast("string").alias("text"))
        key = [F.xxhash64("text").alias("k0"), F.xxhash64(F.lit(1), "text").alias("k1")]
        full = T.StructType([*slim.schema.fields, *schema.fields[-4:]])
        path = scratch_path(spark, "hits")
        for block in chain([first, second], blocks):
            sent = send(block)
            part = scanned(slim, sent, full).filter(F.size(a) > 0).select(*key, runs.alias("r"), i.alias("n"))
            part.groupBy("k0", "k1").agg(F.first("r").alias("r"), F.first("n").alias("n")).write.mode("append").parquet(path)
            sent.unpersist()
        hits = spark.read.parquet(path).groupBy("k0", "k1").agg(
            F.array_sort(F.flatten(F.collect_list("r"))).alias("r"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("n")))).alias("n"))
        # Written, so that the planner knows its size and sends it to the texts if it is small.
        found = [fresh(x, [*docs.columns, *own, *names]) for x in ("k0", "k1", "found_runs", "found_items")]
        hits = cut_lineage(hits.toDF(*found), "hits")
        k0, k1, r, n = (F.col(f"`{x}`") for x in found)
        counted = scanned(docs, send([]), schema)
        text = F.col("text").cast("string")
        match = (k0 == F.xxhash64(text)) & (k1 == F.xxhash64(F.lit(1), text))
        out = counted.join(hits, match, "left").select(
            *columns, w.alias(as_words), _merged_runs(F.coalesce(r, F.array().cast(
                "array<struct<start:int,end:int>>"))).alias(as_runs),
            F.coalesce(n, F.array().cast("array<string>")).alias(as_items))
    n_hit = F.aggregate(as_runs, F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]))
    return out.withColumn(as_hit, n_hit).withColumn(as_found, F.col(as_hit) > 0)


def _renamed(task, names: list[str]):
    return lambda batches: (x.rename_columns(names) for x in task(batches))


def _merged_runs(runs):
    """Sorted word ranges with those that overlap or touch made one."""
    one = "array<struct<start:int,end:int>>"

    def step(done, run):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (run["start"] <= last["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))) \
            .otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast(one), step)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.0,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contamination, in their own columns.

    A document goes when more than ``drop_share`` of its words are hit (0: at any hit); from others the hit runs are
    cut out of the text.
    """
    names = tuple(fresh(x, docs.columns) for x in RESULTS)
    n_words, hit_runs, n_hit, *_ = map(F.col, names)
    kept = scan(docs, benchmark, window, block_bytes, names).filter(n_hit <= F.lit(float(drop_share)) * n_words)
    if drop_share > 0:
        @F.udf("string", useArrow=True)
        def cut(text, starts, ends):
            if not starts:
                return text
            raw, at, parts = text.encode(), 0, []
            words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
            for a, b in zip(starts, ends, strict=True):
                parts.append(raw[at:words.starts[a]])
                at = int(words.ends[b - 1])
            return b"".join([*parts, raw[at:]]).decode()

        kept = kept.withColumn("text", F.when(n_hit > 0, cut("text", hit_runs["start"], hit_runs["end"]))
                               .otherwise(F.col("text")))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` words inside windows of the benchmark, ``n_items`` with such windows, the digest
    ``items_sha256`` of their ids, ``contaminated``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW):
    """The query's rows by plain loops, for tests."""
    import re

    def words(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    wanted: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wanted.setdefault(tuple(w[i:i + size]), set()).update([] if item is None else [str(item)])
    sizes = {len(x) for x in wanted}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (t := tuple(w[i:i + size])) in wanted:
                    hit.update(range(i, i + size))
                    names |= wanted[t]
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
                    bool(hit)))
    return out
