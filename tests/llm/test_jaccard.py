import random

import numpy as np
import pytest
from brute import components, shingles

from tidemill.llm import jaccard as j

SF = "/root/testdata/sf0.001"


def run(spark, docs):
    found = j.cluster(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted((tuple(r) for r in found.select("id", "n", "component_id").collect()), key=str)


def copies(rnd, n_words, n, edits):
    base = [f"w{rnd.randrange(5000)}" for _ in range(n_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [None, "", " \n", "a", "a b", "A B", "a b c d", "a b c d e", "a b c d e f"]
    for size in (6, 8, 9, 12, 20, 40, 90, 200, 400):
        texts += copies(rnd, size, 8, max(1, size // 30))
    texts += [f"{passage} " + " ".join(f"q{rnd.randrange(10 ** 6)}" for _ in range(rnd.choice((3, 10, 60)))) for _ in range(90)]
    texts += copies(rnd, 120, 80, 3)
    texts += [texts[-1]] * 5
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    assert run(spark, docs) == sorted(components(docs), key=str)


def test_whole_table(spark, documents):
    got = sorted(tuple(r) for r in j.op7_ngram_jaccard_join(spark, SF).collect())
    assert got == sorted(components(documents))


def test_repeated_rows_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(5, text), (5, text), (None, text), (3, text + " end"), (9, None), (None, ""), (7, "other words here")]
    assert run(spark, docs) == sorted(
        [(5, 26, 3), (5, 26, 3), (None, 26, 3), (3, 27, 3), (9, 0, 9), (None, 0, None), (7, 1, 7)], key=str)
    kept = j.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(
        [(3, text + " end"), (9, None), (None, ""), (7, "other words here")], key=str)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert j.keep_one(spark.createDataFrame([], "doc_id long, text string, n int")).columns == ["doc_id", "text", "n"]


def test_keep_one_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2), (1, "a b c d e f g", 1, 2), (2, "a b c d e f g", 3, 4)],
                                 "doc_id long, text string, text_key int, turn int")
    assert [tuple(r) for r in j.keep_one(docs).collect()] == [(1, "a b c d e f g", 1, 2)]


def test_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:55_000])), (3, " ".join(words[:30_000])), (4, "z" * 2_000_000)]
    assert run(spark, docs) == [(1, 59_996, 1), (2, 54_996, 1), (3, 29_996, 3), (4, 1, 4)]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bound_of_agreeing_cells(percent):
    """Every linked pair agrees on more cells than either set has spare, or is left to the smallest hashes."""
    rnd = random.Random(percent)
    for _ in range(300):
        n = rnd.choice((4, 5, 6, 9, 15, 40, 150, 600))
        words = [f"v{rnd.randrange(10 ** 9)}" for _ in range(n + 4)]
        other = words[:max(5, n + 4 - rnd.randrange(1 + n * (100 - percent) // 100))]
        texts = [" ".join(words).encode(), " ".join(other).encode()]
        sets = j.Sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 5)
        a, b = shingles(texts[0].decode()), shingles(texts[1].decode())
        if a == b or 100 * len(a & b) < percent * len(a | b):
            continue
        families = list(sets.families(percent))
        small, large = int(np.argmin(sets.sizes)), int(np.argmax(sets.sizes))
        _, home, cells, spare = families[j.HOME]
        band = home[small]
        role = j.HOME if home[large] == band else j.PROBE
        _, bands, cells2, _ = families[role]
        assert bands[large] == band and cells2[large] == cells[small]
        both = np.array([band, band])
        at, sig = sets.cells(both, np.array([cells[small]] * 2))
        agree = len(set(sig[at == 0].tolist()) & set(sig[at == 1].tolist()))
        empty = cells[small] - np.bincount(at, minlength=2)
        assert agree + min(empty) > spare[small]
