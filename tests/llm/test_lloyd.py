import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import lloyd

SF = "/root/testdata/sf0.001"


def closest(part, book):
    far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
    return min(range(len(far)), key=lambda i: (far[i], i)), min(far)


def by_loops(rows, parts=4, entries=256, rounds=4):
    """(vec_id, vector, label) to ({row number: (code, error)}, codebooks), in Python's integers."""
    rows = [(i, r, [math.floor(1024 * x) for x in r[1]]) for i, r in enumerate(rows)
            if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[1][0] is None, r[1][0], r[1][1]))
    if not rows:
        return {}, [[]] * parts
    w = len(rows[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for _, _, v in rows] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(closest(x, books[p])[0], []).append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = {}
    for k, (i, _, _) in enumerate(rows):
        found = [closest(cut[p][k], books[p]) for p in range(parts)]
        out[i] = "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)
    return out, books


def digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, row int")
    df = df.repartition(5)
    books = lloyd.train(df, "vec_id", **kw)
    want, b = by_loops(rows, **kw)
    assert books.digest() == digest(b)
    got = {r.row: (r.code, r.error) for r in lloyd.encode(df, books).collect()}
    assert got == {i: (code, error if error < 1 << 63 else None) for i, (code, error) in want.items()}
    return books


def test_as_loops_with_all_kinds_of_rows(spark):
    rnd = random.Random(3)
    rows = [(i // 2, [rnd.gauss(0, 0.2) for _ in range(8)], i % 3) for i in range(300)]
    rows += [(None, [0.25] * 8, None), (900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [0.1] * 7 + [math.nan], 1),
             (903, [math.inf] + [0.1] * 7, None), (-5, [-math.inf] + [0.1] * 7, None)]
    rows += [(1000 + i, [0.5, -0.5, 0.25, 0.0, 0.0, 0.0, 0.0, 1e-9], 7) for i in range(400)]
    check(spark, rows, entries=16)
    check(spark, rows, entries=16, parts=2, rounds=1)


def test_large_components_are_exact(spark):
    rnd = random.Random(5)
    for size in (3.0, 3e3, 4e5, 3e9):
        check(spark, [(i, [rnd.uniform(-size, size) for _ in range(4)], 0) for i in range(60)], entries=5, parts=2)


def test_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    books = lloyd.train(df, "vec_id", parts=2, entries=1)
    assert [r.error for r in lloyd.encode(df, books).orderBy("vec_id").collect()][0] is None


def test_ties_go_to_the_lower_entry():
    book = np.array([[2, 0], [0, 0], [0, 0], [4, 0]], object)
    entry, far = lloyd.nearest(np.array([[1, 0], [3, 0], [0, 0], [9, 9]]), book)
    assert entry.tolist() == [0, 0, 1, 3] and far.tolist() == [1, 1, 0, 106]


def test_hot_entries_are_salted(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "SHARE", 50)
    rnd = random.Random(7)
    rows = [(i, [0.5] * 4 if i % 3 else [rnd.gauss(0, 0.3) for _ in range(4)], 0) for i in range(1200)]
    check(spark, rows, entries=8)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = by_loops(rows)
    sums = {}
    for i, (_, error) in want.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + error
    expected = sorted((rows[i][0], code, error, sums[rows[i][2]], digest(books)) for i, (code, error) in want.items())
    assert sorted(map(tuple, lloyd.op11_vector_codes(spark, SF).collect())) == expected


def test_null_labels_sum_together_and_empty_tables(spark, tmp_path):
    rows = [(i, [float(i), 1.0, 2.0, i / 7], None if i % 2 else 1) for i in range(40)] + [(3, None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("own")) \
        .withColumn("v", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = lloyd.op11_vector_codes(spark, str(tmp_path)).collect()
    assert len(out) == 40 and len({r.label_error for r in out if r.vec_id % 2}) == 1
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    empty.write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert lloyd.op11_vector_codes(spark, str(tmp_path / "none")).collect() == []


def test_decode_comes_near(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = lloyd.train(df, "vec_id")
    both = lloyd.decode(lloyd.encode(df.withColumn("same", F.col("embedding")), books), books).collect()
    for r in both[:50]:
        assert sum((a - b) ** 2 for a, b in zip(r.same, r.approximation, strict=True)) < r.error / 1024 ** 2 + 0.05


def test_ragged_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 4), (2, [1.0] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="different lengths"):
        lloyd.train(df, "vec_id")
    with pytest.raises(ValueError, match="equal parts"):
        lloyd.train(df.filter("vec_id = 1"), "vec_id", parts=3)
