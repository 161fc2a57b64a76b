import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import balltree as b

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or ""))


def by_loops(docs, items, k=10):
    """(item number, rank, doc id, score), every document scored for every item."""
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t, sum(t.values())) for i, t in docs if t]
    n_docs, n_words = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, ts, _ in docs for t in ts)
    out = []
    for number, (_, text) in enumerate(items):
        found = []
        for i, ts, n in docs:
            m = 25 + 75 * n * n_docs // n_words
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * ts[t] // (1000 * ts[t] + 8 * m))
                    for t, c in terms(text).items() if t in ts)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(number, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k])]
    return out


def check(spark, docs, items, **kw):
    ds = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("item", F.lit("own"))
    qs = spark.createDataFrame([(number, t) for number, (_, t) in enumerate(items)], "item_id long, text string") \
        .withColumn("doc_id", F.lit("own"))
    got = sorted(map(tuple, b.search(ds, qs, **kw).collect()))
    assert got == by_loops(docs, items, **kw)


def some_docs(seed, n, vocabulary=60):
    rnd = random.Random(seed)
    return [(i, " ".join(f"w{int(rnd.paretovariate(0.7)) % vocabulary}" for _ in range(rnd.randrange(60)))) for i in range(n)]


def test_as_loops(spark, monkeypatch):
    monkeypatch.setattr(b, "TREE", 64)
    docs = some_docs(1, 500) + [(500, None), (501, ""), (502, "!? --"), (503, "ÄÖ w1 W1 été w2w"), (504, "w1 " * 20_000)]
    docs += [(600 + i, "the same words w3 w4") for i in range(300)] + [(700, "w5 w5"), (700, "w5 w5"), (None, "w5 w5")]
    items = [(0, t) for _, t in some_docs(2, 30)] + [(1, None), (2, ""), (3, "nowhere"), (4, "same words the"), (5, "w5"),
                                                     (5, "w5"), (6, "W1 ÉTÉ été ÄÖ"), (7, "w1 w1 w1 w2")]
    check(spark, docs, items)
    check(spark, docs, items, k=3)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(b, "TERMS", 20)
    check(spark, some_docs(3, 200), [(0, t) for _, t in some_docs(4, 12)])


def test_empty_tables(spark):
    docs, none = some_docs(5, 20), []
    check(spark, none, [(0, "w1 w2")])
    check(spark, docs, none)
    check(spark, [(1, None), (2, "")], [(0, "w1")])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 7), st.integers(1, 10 ** 6), min_size=1), min_size=1, max_size=60),
       st.dictionaries(st.integers(0, 7), st.integers(1, 10 ** 5), min_size=1), st.integers(1, 4), st.integers(1, 8))
def test_tree_never_prunes_an_answer(rows, query, k, leaf):
    indptr = np.cumsum([0, *map(len, rows)])
    cols = np.array([c for r in rows for c in sorted(r)], np.int32)
    vals = np.array([r[c] for r in rows for c in sorted(r)], np.int64)
    exact = np.zeros(8, np.int64)
    for c, w in query.items():
        exact[c] = w
    best = []
    tree = b.BallTree(indptr, cols, vals, leaf)
    tree.search(exact, list(range(len(rows))), best, k)
    want = sorted(((sum(query.get(c, 0) * v for c, v in r.items()), -i) for i, r in enumerate(rows)), reverse=True)
    assert sorted(best, reverse=True) == [w for w in want if w[0] > 0][:k]
    for node, (lo, hi, *_) in enumerate(tree.nodes):
        bound = tree.bound(node, exact.astype(float), exact.astype(float) ** 2)
        assert all(bound >= sum(query.get(c, 0) * v for c, v in rows[i].items()) for i in tree.order[lo:hi])


def test_clusters_are_pruned():
    """Documents of 64 topics: an item of one topic leaves nearly all others alone."""
    rnd = np.random.default_rng(1)
    topic = np.repeat(np.arange(64), 64)
    cols = (topic[:, None] * 10 + np.arange(10)).ravel().astype(np.int32)
    vals = rnd.integers(100, 1000, cols.size)
    tree = b.BallTree(np.arange(len(topic) + 1) * 10, cols, vals)
    exact = np.zeros(640, np.int64)
    exact[70:80] = 5
    best = []
    assert tree.search(exact, list(range(len(topic))), best, 10) <= 256 and {-i // 64 for _, i in best} == {7}


def test_words_of_the_same_hash_are_told_apart():
    known = b.Terms([b"alpha", b"beta"])
    known.data = np.frombuffer(b"alphabetx", np.uint8)
    data, offsets = b.text_buffer(b.pa.array(["alpha beta gamma Alpha"]))
    hit, term = known.find(b.Words(data, offsets, b.ALNUM))
    assert hit.tolist() == [0, 3] and term.tolist() == [0, 0]


def test_terms_of_one_hash_are_refused(monkeypatch):
    monkeypatch.setattr(b.Words, "_hash", lambda self: np.zeros(len(self.starts), np.uint64))
    with pytest.raises(ArithmeticError):
        b.Terms([b"one", b"two"])


def test_whole_table(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, b.op12_ranked_search(spark, SF).collect()))
    assert got == sorted((items[i][0], *rest) for i, *rest in by_loops(documents, items))
