import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import token_counts as t

SF = "/root/testdata/sf0.001"
TEXT = st.text(alphabet=st.sampled_from(list("ab'srevdml  \n\t1é,-!😀")), max_size=80)
EDITS = st.lists(st.tuples(st.integers(0, 90), st.integers(0, 9), TEXT.filter(lambda x: len(x) < 9)), max_size=6)


def words():
    return t.Vocabulary.of(t.RANKS, t.PATTERN)


def spliced(text, start, removed, inserted):
    start = min(max(0, start), len(text))
    return text[:start] + inserted + text[start + max(0, removed):]


@settings(max_examples=400, deadline=None)
@given(TEXT, EDITS, st.sampled_from([1, 2, 5, 64]))
def test_tree_follows_edits(text, edits, leaf):
    tree = t.CountTree(*words().split(text), leaf=leaf)
    for e in edits:
        after, _ = t.edit(text, tree, words(), *e)
        text = spliced(text, *e)
        assert after == text
        assert tree.flat() == words().split(text)
        assert tree.total == len(words().encode(text)) and tree.chars[1] == len(text)


def test_an_edit_encodes_little():
    rnd = random.Random(1)
    text = " ".join(f"word{rnd.randrange(999)}" for _ in range(50_000))
    tree = t.CountTree(*words().split(text))
    for _ in range(50):
        text, n = t.edit(text, tree, words(), rnd.randrange(len(text)), 3, " x")
        assert n <= 12
    assert tree.flat() == words().split(text)


def test_whole_table(spark, documents):
    texts = dict(documents)
    plan = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", t.sample_edits(F.col("doc_id")).alias("e"))
    edits = {r.doc_id: r.e for r in plan.collect()}
    for r in t.op8_token_counts(spark, SF).collect():
        text = texts[r.doc_id]
        assert r.n_tokens_before == len(words().encode(text)) and r.n_edits == len(edits[r.doc_id])
        for e in edits[r.doc_id]:
            text = spliced(text, e.start, e.removed, e.inserted)
        assert r.n_tokens == len(words().encode(text))
        assert r.text_sha256 == __import__("hashlib").sha256(text.encode()).hexdigest()


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, None), (2, "", [(0, 0, "new text")]), (3, "some words", [None, (None, 4, None), (99, 1, "!")]),
            (None, "twice", []), (None, "twice", [])]
    df = spark.createDataFrame(rows, f"id long, text string, edits {t.EDIT}").withColumn("counts", F.lit("own")) \
        .withColumn("0", F.lit("zero"))
    out = t.apply_edits(t.build(df))
    assert out.columns == ["id", "0", "text", "lengths", "counts", "n_tokens", "n_encoded"]
    got = sorted(((r.id, r.text, r.n_tokens, sum(r.counts)) for r in out.collect()), key=str)
    n = {x: len(words().encode(x)) for x in ("", "new text", " words!", "twice")}
    assert got == sorted([(1, "", 0, 0), *((i, x, n[x], n[x]) for i, x in (
        (2, "new text"), (3, " words!"), (None, "twice"), (None, "twice")))], key=str)
    assert t.apply_edits(t.build(df.limit(0))).collect() == []


def test_trees_survive_a_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c " * 1000), (2, "x")], "id long, text string")
    t.build(df).write.parquet(str(tmp_path / "trees"))
    later = spark.read.parquet(str(tmp_path / "trees")).withColumn("edits", F.array(F.struct(
        F.lit(5).alias("start"), F.lit(0).alias("removed"), F.lit("zz").alias("inserted"))))
    rows = {r.id: r for r in t.apply_edits(later).collect()}
    assert all(r.n_tokens == len(words().encode(r.text)) for r in rows.values()) and rows[1].n_encoded < 10
