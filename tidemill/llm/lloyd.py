"""Product codes of vectors: codebooks by Lloyd's rounds over members that stay where they live, then encoding.

A vector's components become integers, floor(1024 x), and the vector is cut into equal consecutive parts. Each part
position has a codebook of its own. The table of members holds one row per part, dealt to owners by (position, entry,
salt): an owner's files hold the members of few entries, and an entry of many members has a salt for each share of them
(the mean of all entries, ``SHARE`` rows at most), so no owner grows with the largest entry. A round has two steps.

* Update: each task sums its resident members per entry, and only these sums meet (at most entries x width of them a
  task).
* Assignment: each task compares its resident members with the new codebooks. Members that keep their entry are written
  where they are, without a shuffle; only those that change entry go through the next shuffle, to their new owners.

Everything is integer arithmetic: products run through floating matrix products only while all sums are exactly
representable (24 or 53 bits by the norms at hand), beyond that through Python's integers. So reruns, retries and other
partitionings give the same codes. Each step is a table in the shared folder; superseded ones are removed. The driver
holds the codebooks (entries x width numbers), which is also all that is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import fresh, table
from tidemill.session import cut_lineage, discard, scratch_path

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Members of one entry that one salt holds at most.
SHARE = 1 << 20
ROWS = 4096
LARGEST = 1 << 62
MEMBER = "position int, entry int, part array<bigint>"


@dataclass(frozen=True)
class Codebooks:
    """One array (entries, width) of integers per part position, of Python integers."""

    books: tuple[np.ndarray, ...]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, comma-joined, by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel()).encode()).hexdigest()


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) as 64-bit integers; beyond 2**62 they stay there."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * SCALE)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (ties: the lower) and the squared distance, as Python integers if large."""
    if not parts.size:
        return np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    norm = lambda x: float((x.astype(np.float64) ** 2).sum(1).max()) ** 0.5
    a, b = norm(parts), norm(book)
    largest = 1.01 * (a + b) ** 2 + 1
    if largest < 1 << 53:
        kind = np.float32 if largest < 1 << 24 else np.float64
        rows, other = parts.astype(kind), book.astype(kind)
        scores = rows @ (other.T * kind(-2))
        scores += (other * other).sum(1)
        entry = scores.argmin(1)
        picked = book.astype(np.int64)[entry]
        return entry.astype(np.int32), ((parts - picked) ** 2).sum(1)
    entries, far = [], []
    for row in parts.astype(object):
        distances = ((book.astype(object) - row) ** 2).sum(1)
        entries.append(int(distances.argmin()))
        far.append(distances[entries[-1]])
    return np.array(entries, np.int32), np.array(far, object)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()[:5]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), pa.int64()))


def _first_members(batches, books):
    """Vectors to members with their first entries."""
    for batch in _slices(batches):
        rows = integers(_matrix(batch.column(0)))
        for position, (a, b) in enumerate(_cuts(rows.shape[1], len(books))):
            part = rows[:, a:b]
            entry, _ = nearest(part, books[position])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), position, np.int32)), pa.array(entry), _lists(part)], ["position", "entry", "part"])


def _reassigned(batches, books):
    """Members with their new entries and whether they change owner."""
    for batch in _slices(batches):
        position, old = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        parts, entry = _matrix(batch.column(2)), old.copy()
        for p, book in enumerate(books):
            here = np.flatnonzero(position == p)
            if len(here):
                entry[here] = nearest(parts[here], book)[0]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(entry), batch.column(2), pa.array((entry != old).astype(np.int32))],
            ["position", "entry", "part", "moved"])


def _sums(batches, entries: int):
    """Number of members and sums of their components by entry, over all of a task."""
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in _slices(batches):
        cell = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * entries + batch.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        parts = _matrix(batch.column(2))[order]
        cells, first, n = np.unique(cell[order], return_index=True, return_counts=True)
        if parts.size and int(np.abs(parts).max()) >= (1 << 62) // ROWS:
            parts = parts.astype(object)
        added = np.add.reduceat(parts, first, axis=0).astype(object) if parts.size else np.zeros((len(cells), 0), object)
        for c, k, s in zip(cells.tolist(), n.tolist(), added, strict=True):
            counts[c] = counts.get(c, 0) + k
            sums[c] = sums[c] + s if c in sums else s
    rows = [(c, k, counts[c], Decimal(int(x))) for c, s in sums.items() for k, x in enumerate(s)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                      pa.array([r[2] for r in rows], pa.int64()),
                                      pa.array([r[3] for r in rows], pa.decimal128(38, 0))], ["cell", "place", "n", "s"])


def finite(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    return rows.filter(F.forall(F.col(f"`{column}`"), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))))


def _place(rows: DataFrame, entries: int) -> str:
    """Send members to the owners of their entries; an entry has a salt for each share of those that arrive."""
    spark, target = rows.sparkSession, scratch_path(rows.sparkSession, "members")
    counts = cut_lineage(rows.groupBy("position", "entry").agg(F.count("*").alias("n")), "counts")
    # No owner gets more than the mean entry has, nor more than ``SHARE``.
    rows_in_all, cells = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    share = max(1, min(SHARE, rows_in_all // max(1, cells)))
    salts = counts.select("position", "entry", (F.floor(F.col("n") / share) + 1).alias("salts"))
    # At most parts x entries rows, so the broadcast is bounded.
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).join(F.broadcast(salts), ["position", "entry"]) \
        .withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")))
    dealt.repartition("position", "entry", "salt").select("position", "entry", "part").write.parquet(target)
    return target


def _updated(members: DataFrame, books: tuple[np.ndarray, ...], entries: int) -> tuple[np.ndarray, ...]:
    """Each entry's new value from its members: floor(sum / count); unused entries stay."""
    sums = members.mapInArrow(partial(_sums, entries=entries), "cell bigint, place int, n bigint, s decimal(38,0)") \
        .groupBy("cell", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = tuple(b.copy() for b in books)
    for r in sums.collect():
        out[r.cell // entries][r.cell % entries, r.place] = int(r.s) // r.n
    return out


def train(rows: DataFrame, order: str, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the vectors in ``column``, started from those of the ``entries`` smallest values of ``order``.

    Vectors that are null or hold null or non-finite components are left out; null ``order`` comes last, equal ones by
    their vectors. With fewer vectors than ``entries`` there are as many entries as vectors, with none there are none.
    Vectors of different lengths, or of a length that ``parts`` does not divide, raise ValueError.
    """
    spark = rows.sparkSession
    vectors = finite(rows, column).select(F.col(f"`{order}`").alias("o"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    start = vectors.orderBy(F.col("o").asc_nulls_last(), "v").limit(entries).collect()
    if not start:
        return Codebooks(tuple(np.zeros((0, 0), object) for _ in range(parts)))
    if len({len(r.v) for r in start}) > 1:
        raise ValueError("vectors of different lengths")
    first = integers(np.array([r.v for r in start], np.float64).reshape(len(start), -1)).astype(object)
    books = tuple(first[:, a:b].copy() for a, b in _cuts(first.shape[1], parts))
    if not rounds or not first.shape[1]:
        return Codebooks(books)
    assigned = scratch_path(spark, "assigned")
    vectors.select("v").mapInArrow(partial(_first_members, books=books), MEMBER).write.parquet(assigned)
    tables = [_place(spark.read.schema(MEMBER).parquet(assigned), entries)]
    discard(spark, assigned)
    members = spark.read.schema(MEMBER).parquet(tables[0])
    for k in range(rounds):
        books = _updated(members, books, entries)
        if k == rounds - 1:
            break
        settled = scratch_path(spark, "settled")
        members.mapInArrow(partial(_reassigned, books=books), MEMBER + ", moved int").write.partitionBy("moved").parquet(settled)
        for path in tables:
            discard(spark, path)
        now = spark.read.schema(MEMBER + ", moved int").parquet(settled)
        tables = [settled, _place(now.filter("moved = 1").drop("moved"), entries)]
        members = now.filter("moved = 0").drop("moved").union(spark.read.schema(MEMBER).parquet(tables[1]))
    for path in tables:
        discard(spark, path)
    return Codebooks(books)


def _digits(books: tuple[np.ndarray, ...]) -> int:
    return 2 if max(map(len, books)) <= 256 else 8


def _encoded(batches, books):
    digits = _digits(books)
    for batch in _slices(batches):
        rows = integers(_matrix(batch.column(batch.num_columns - 1)))
        codes, error = np.empty((len(rows), len(books)), np.int64), np.zeros(len(rows), object)
        for position, (a, b) in enumerate(_cuts(rows.shape[1], len(books))):
            codes[:, position], far = nearest(rows[:, a:b], books[position])
            error = error + far.astype(object)
        text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
        error = [int(e) if e < 1 << 63 else None for e in error]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array(error, pa.int64())],
                                         names=[str(i) for i in range(batch.num_columns + 1)])


def encode(rows: DataFrame, codebooks: Codebooks, column: str = "embedding") -> DataFrame:
    """``rows`` with usable vectors, ``column`` replaced by ``code`` (two hex digits a part; eight where a codebook has more
    than 256 entries) and ``error``, the squared distance (null beyond 64 bits). Columns named so give way."""
    names = [c for c in rows.columns if c.lower() not in (column.lower(), "code", "error")]
    extra = fresh("v", names)
    inner = finite(rows, column).select(*(F.col(f"`{c}`") for c in names), F.col(f"`{column}`").cast("array<double>").alias(extra))
    types = [*(f.dataType for f in inner.schema.fields[:-1]), T.StringType(), T.LongType()]
    out = inner.mapInArrow(partial(_encoded, books=codebooks.books),
                           T.StructType([T.StructField(str(i), t) for i, t in enumerate(types)]))
    return out.select(*(F.col(f"`{i}`").alias(n) for i, n in enumerate([*names, "code", "error"])))


def _decoded(batches, books, digits: int):
    for batch in _slices(batches):
        codes = batch.column(batch.num_columns - 1).to_pylist()
        vectors = [None if c is None else np.concatenate([
            b[int(c[digits * i:digits * (i + 1)], 16)].astype(np.float64) / SCALE for i, b in enumerate(books)]) for c in codes]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))],
                                         names=[str(i) for i in range(batch.num_columns)])


def decode(rows: DataFrame, codebooks: Codebooks, code: str = "code", into: str = "approximation") -> DataFrame:
    """``rows`` with ``code`` replaced by the vector that it stands for, as doubles; null codes give null."""
    names = [c for c in rows.columns if c.lower() not in (code.lower(), into.lower())]
    inner = rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{code}`").alias(fresh("v", names)))
    types = [*(f.dataType for f in inner.schema.fields[:-1]), T.ArrayType(T.DoubleType())]
    out = inner.mapInArrow(partial(_decoded, books=codebooks.books, digits=_digits(codebooks.books)),
                           T.StructType([T.StructField(str(i), t) for i, t in enumerate(types)]))
    return out.select(*(F.col(f"`{i}`").alias(n) for i, n in enumerate([*names, into])))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per usable row of ``embeddings``: ``code``, ``error``, ``label_error`` (errors summed over equal labels, nulls
    together) and ``codebooks_sha256``. Codebooks are trained on all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(rows, "vec_id")
    coded = cut_lineage(encode(rows, books), "codes")
    # A written table, so that the planner knows its size and broadcasts it only if small.
    labels = cut_lineage(coded.groupBy(F.col("label").alias("other")).agg(F.sum("error").alias("label_error")), "labels")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("other"))) \
        .select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
