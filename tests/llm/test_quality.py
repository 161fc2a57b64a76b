import math

import brute
from pyspark.sql import functions as F

from tidemill.llm import quality as q

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", "   \n\t", "one", "a b c", "a b c a b c", "a a a a", "x y\nx y\n x y\nx y", "a\x0bb\x0cc\rd\te", "a b c",
    "# $ % & | < > * é#", "a b c d a b c e b c d " * 40, "w" * 100_000, "\n" * 5000 + "a\na", "l m n\n\n\nl m n\nl m n",
    " ".join(f"w{i}" for i in range(30_000)), " ".join(f"w{i % 977}" for i in range(9_000)),
    " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)),
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_features(spark):
    got = q.judge(docs(spark, TEXTS)).select(*COLUMNS).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [brute.quality(i, t) for i, t in enumerate(TEXTS)]


def test_whole_table(spark, documents):
    rows = q.op4_quality_rules(spark, SF).collect()
    assert sorted(tuple(r)[:7] for r in rows) == sorted(brute.quality(*d) for d in documents)
    assert all(not (r.base_failed and r.kept) for r in rows)


def em(patterns):
    """The same model by plain loops over (votes, count) rows."""
    names, model = list(q.RULES), q.start_model()
    for _ in range(q.ROUNDS):
        sums = {"n": 0, "good": 0.0, **{f"{c}_{r}": 0.0 for c in ("gg", "gb", "bg", "bb") for r in names}}
        for votes, n in patterns:
            good, bad = model.good, 1 - model.good
            for r, v in zip(names, votes):
                if v:
                    good *= model.on_good[r] if v > 0 else 1 - model.on_good[r]
                    bad *= 1 - model.on_bad[r] if v > 0 else model.on_bad[r]
            p = good / (good + bad)
            sums["n"] += n
            sums["good"] += n * p
            for r, v in zip(names, votes):
                if v:
                    sums[("gg_" if v > 0 else "gb_") + r] += n * p
                    sums[("bg_" if v > 0 else "bb_") + r] += n * (1 - p)
        before, model = model, q.updated(sums)
        if max(abs(before.good - model.good), *(abs(x[r] - y[r]) for r in names for x, y in (
                (before.on_good, model.on_good), (before.on_bad, model.on_bad)))) < q.TOLERANCE:
            break
    return model


def test_em_against_loops(spark):
    patterns = q.patterns_of(q.with_features(spark.read.parquet(f"{SF}/documents.parquet"), {f: f for f in q.FEATURES}),
                             {f: F.col(f) for f in q.FEATURES})
    model, other = q.fit(patterns), em([(tuple(r)[:-1], r.n) for r in patterns.collect()])
    assert abs(model.good - other.good) < 1e-6
    assert all(abs(model.on_good[r] - other.on_good[r]) < 1e-6 and abs(model.on_bad[r] - other.on_bad[r]) < 1e-6 for r in q.RULES)


def test_labelled_junk_goes_and_labelled_prose_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.judge(docs.select("doc_id", "text")).filter("not base_failed").join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == x] for x in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_junk_goes_and_prose_stays(spark):
    prose = [" ".join(f"word{(i * 7 + k) % 311}" for i in range(150)).replace("0 ", "0. ") + "." for k in range(60)]
    prose = ["".join(c if not c.isdigit() else "abcdefghij"[int(c)] for c in t) for t in prose]
    junk = [" ".join("$%|<>#12"[(i + k) % 8] * 2 + "9|" for i in range(200)) for k in range(12)]
    rows = q.judge(docs(spark, prose + junk)).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True] * 60 + [False] * 12
    kept = q.keep_good(docs(spark, prose + junk).withColumn("n_words", F.lit("own")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert kept.columns == ["doc_id", "text", "n_words"]


def test_empty_table(spark):
    assert q.judge(docs(spark, [])).collect() == []
    assert q.keep_good(docs(spark, [])).collect() == []
