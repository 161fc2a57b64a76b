import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import mixing as m

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def water(sizes, weights=m.WEIGHTS, most=m.MOST):
    """Targets by repeated sharing of the excess."""
    names = sorted((x for x in sizes if x is not None)) + [x for x in sizes if x is None]
    w = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    full = {}
    while True:
        open_ = [x for x in names if x not in full]
        left = sum(sizes.values()) - sum(full.values())
        share = {x: left * w[x] / sum(w[y] for y in open_) for x in open_}
        over = [x for x in open_ if share[x] > most * sizes[x]]
        if not over:
            return {**full, **share}
        full |= {x: most * sizes[x] for x in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice((0, 1, 5, 50, 10_000, 10 ** 9)) for i in range(rnd.randrange(1, 9))} | {None: 40, "é": 3, "Z": 7}
    got = m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1)), max_size=80), st.integers(0, 10 ** 6))
def test_flight_keeps_both_totals(units, seed):
    size, p = np.array([u[0] for u in units], dtype=np.int64), np.array([u[1] for u in units], dtype=float)
    out = m.fly(size, p, np.random.default_rng(seed))
    assert ((out > 0) & (out < 1)).sum() <= 2 and ((out >= 0) & (out <= 1)).all()
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and size @ out == pytest.approx(size @ p, abs=1e-3)


def test_flight_is_fair():
    size, p = np.array([1, 3, 8, 2, 5, 9, 4, 7]), np.array([0.2, 0.5, 0.7, 0.4, 0.4, 0.9, 0.1, 0.8])
    runs = np.array([m.fly(size, p, np.random.default_rng(i)) for i in range(4000)])
    assert np.abs(runs.mean(axis=0) - p).max() < 0.03


def corpus(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "big" if i % 3 == 0 else rnd.choice(["a", "b", "c", "d", None])
        rows.append((i, " ".join(["w"] * rnd.choice((0, 3, 20, 50, 400))), source))
    return rows


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_mix(spark, block):
    rows = corpus(3000) + [(None, "x y", "a"), (7, None, "a"), (5, "twice here", "b"), (5, "twice here", "b")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    found = m.mix(df, block=block)
    out = found.collect()
    assert sorted((str(r.id), r.size, str(r.source)) for r in out) == sorted((str(i), len((t or "").split()), str(s)) for i, t, s in rows)
    total = {}
    for r in out:
        assert 0 <= r.copies <= m.MOST and r.taken == r.copies * r.size
        total.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 0.01 * target for target, taken in total.values())
    again = m.mix(spark.createDataFrame(rows, DOCS).repartition(3), block=block)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def lopsided(big=1000, small=40):
    """One large source, smaller ones of one or two blocks of 64 with one long document each."""
    rnd = random.Random(5)
    rows = [(i, 50 + rnd.randrange(50), "big") for i in range(big)]
    for k in range(6):
        more = small if k % 2 else 3 * small
        rows += [(10_000 * (k + 1) + i, 50 + rnd.randrange(50) if i else 400, f"s{k}") for i in range(more)]
    return [(i, " ".join(["w"] * n), source) for i, n, source in rows]


def test_small_sources_beside_a_large_one(spark):
    total = {}
    for r in m.mix(spark.createDataFrame(lopsided(), DOCS), block=64).collect():
        total.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 2 for target, taken in total.values()), total


def test_whole_table(spark):
    rows = m.op6_source_mix(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum({(r.source_size, r.target): r.target for r in rows}.values()) > 0
    assert all(r.taken <= 3 * r.size for r in rows)


def test_no_words_and_empty_table(spark):
    rows = [(1, None, "a"), (2, " ", None)]
    assert [(r.size, r.target, r.taken) for r in m.mix(spark.createDataFrame(rows, DOCS)).collect()] == [(0, 0.0, 0)] * 2
    assert m.mix(spark.createDataFrame([], DOCS)).collect() == []
    assert m.draw(spark.createDataFrame([], DOCS)).collect() == []


def test_draw(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 9)), f"s{i % 2}") for i in range(200)] + [(1, "same row", "s1")] * 4
    df = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("own")).withColumn("size", F.create_map(F.lit("k"), F.lit(1)))
    mixed, drawn = m.mix(df), m.draw(df)
    assert drawn.columns == ["doc_id", "text", "source", "copies", "size", "copies_", "taken"]
    assert drawn.agg(F.sum("taken")).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert drawn.filter("doc_id = 1 and text = 'same row'").count() <= 1
