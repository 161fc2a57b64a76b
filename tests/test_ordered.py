"""Skew-proof ordered computations against brute force, with one key holding most rows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import ordered, series


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        minute = rng.randrange(0, 3 * 24 * 60)
        rows.append((i, key, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), rng.randrange(0, 20), rng.random() < 0.7))
    return spark.createDataFrame(rows, "id int, key string, at timestamp_ntz, v int, hit boolean"), pd.DataFrame(
        rows, columns=["id", "key", "at", "v", "hit"])


def _groups(pdf):
    return pdf.assign(key=pdf["key"].fillna("<null>")).sort_values(["at", "id"]).groupby("key")


def test_next_row(events):
    df, pdf = events
    got = {r.id: r.nxt for r in ordered.with_next(df, ["key"], "at", "id", {"nxt": "id"}).collect()}
    want = {}
    for _, g in _groups(pdf):
        ids = g["id"].tolist()
        want |= dict(zip(ids, ids[1:] + [None]))
    assert got == want


def test_running_sum(events):
    df, pdf = events
    got = {r.id: r.total for r in ordered.with_running_sum(df, ["key"], "at", "id", "v", "total").collect()}
    want = {}
    for _, g in _groups(pdf):
        want |= dict(zip(g["id"], g["v"].cumsum()))
    assert got == want


def test_streaks(events, rows):
    df, pdf = events
    got = sorted(r.length for r in ordered.longest_streaks(df, ["key"], "at", "id", "hit").collect())
    want = []
    for _, g in _groups(pdf):
        n = 0
        for hit in [*g["hit"], False]:
            if hit:
                n += 1
            elif n:
                want.append(n)
                n = 0
    assert got == sorted(want)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles(spark, accuracy):
    rng = np.random.default_rng(3)
    values = {"hot": rng.exponential(10, 4000).round(1), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 500), "one": np.array([7.5]),
              None: rng.normal(0, 1, 900)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("one", None)], "key string, x double")
    probs = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.key: r for r in ordered.exact_percentiles(df, ["key"], "x", probs, accuracy).collect()}
    for key, xs in values.items():
        assert got[key].n == len(xs)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(xs, 100 * p), abs=1e-9), (key, name)


@pytest.fixture(scope="module")
def one_moment(spark):
    """A third of a million rows of one key, all at one time."""
    return spark.range(300_000).select(F.lit("hot").alias("key"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"),
                                       F.xxhash64("id").alias("id"), (F.col("id") % 7 == 0).alias("hit"), F.lit(1).alias("one"))


def test_one_key_at_one_time_is_cut_into_slices(spark, one_moment):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordered.sliced(one_moment, ["key", "at", "id"]).groupBy(ordered.SLICE).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    total = ordered.with_running_sum(one_moment, ["key"], "at", "id", "one", "n")
    place = total.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(place) == (300_000, 1, 300_000)
    after = ordered.with_next(one_moment, ["key"], "at", "id", {"nxt": "id"})
    assert after.filter("nxt IS NULL").count() == 1 and after.filter("nxt <= id").count() == 0


def test_percentiles_of_one_key_with_a_million_values(spark, monkeypatch):
    df = spark.range(1_000_000).select(F.lit("k").alias("key"), (F.col("id") * 2 + 1).cast("double").alias("x"))
    probs = {"p50": 0.5, "p95": 0.95, "top": 1.0}
    want = {name: 1 + 2 * p * 999_999 for name, p in probs.items()}
    for held in (100_000, 500):  # below, the window over a key gives way to slices
        monkeypatch.setattr(ordered, "HELD", held)
        for keys in (["key"], []):
            got = ordered.exact_percentiles(df, keys, "x", probs, accuracy=1000).first()
            assert {name: got[name] for name in probs} == pytest.approx(want, abs=1e-6)


def test_percentiles_without_key(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    assert ordered.exact_percentiles(df, [], "x", {"m": 0.5}).first().m == 50.5
    assert ordered.exact_percentiles(df.filter("x < 0"), [], "x", {"m": 0.5}).count() == 0


def test_sample_is_exact_with_many_copies(spark):
    copies = spark.range(1000).select(F.lit(1).alias("a"), F.lit("same").alias("b"))
    others = spark.range(500).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b"))
    df = copies.unionByName(others)
    for n in (1, 7, 400, 1200, 1500, 9000):
        got = ordered.exact_sample(df, n)
        assert got.count() == min(n, 1500)
        assert got.exceptAll(df).count() == 0


def test_global_rank(spark):
    rng = random.Random(1)
    values = [5.0] * 300 + [round(rng.random() * 50, 1) for _ in range(700)] + [None] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = {r.id: r["rank"] for r in series.global_rank(df, "v").collect()}
    known = [v for v in values if v is not None]
    for i, v in enumerate(values):
        assert got[i] == (1 + sum(o > v for o in known) if v is not None else len(known) + 1)
