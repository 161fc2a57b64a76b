import brute
import corpus_pipeline as p
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r.kept for r in quality.judge(docs).select("doc_id", "kept").collect()}
    good = p.quality_rules(spark, docs, SF).cache()
    assert good.columns == COLUMNS and ids(good) == sorted(i for i, kept in judged.items() if kept)

    single = p.near_duplicates(spark, good, SF).cache()
    groups = brute.components([(r.doc_id, r.text) for r in good.collect()])
    assert single.columns == COLUMNS and ids(single) == sorted({c for _, _, c in groups})

    clean = p.decontamination(spark, single, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = decontaminate.brute_force([(r.doc_id, r.text) for r in single.collect()], items)
    assert clean.columns == COLUMNS and ids(clean) == sorted(r[0] for r in hit if not r[-1])

    private = p.personal_data(spark, clean, SF).cache()
    before = {r.doc_id: r for r in clean.collect()}
    assert private.columns == COLUMNS and ids(private) == ids(clean)
    for r in private.collect():
        found = sum(brute.pii(r.doc_id, before[r.doc_id].text)[1:5])
        assert (r.text != before[r.doc_id].text) >= (found > 0) and r.n_chars == len(r.text)
        assert sum(brute.pii(r.doc_id, r.text)[1:5]) == 0

    mixed = p.source_mix(spark, private, SF)
    assert mixed.columns == [*COLUMNS, "copies", "taken"]
    assert set(ids(mixed)) <= set(ids(private))
    assert mixed.filter("copies < 1 or copies > 3").isEmpty()


def test_run_is_the_chain_of_stages(spark):
    rows = p.run(spark, SF)
    assert rows.count() > 0 and rows.filter(F.col("taken") < 1).isEmpty()
    assert sorted(map(str, rows.collect())) == sorted(map(str, p.run(spark, SF).collect()))


def test_odd_rows_pass(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "short", None, "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, docs.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, docs.schema).collect())
    assert p.quality_rules(spark, docs, SF).isEmpty() and p.source_mix(spark, docs.limit(0), SF).isEmpty()
