import time

import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontaminate as d

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
LONG = "one two three four five six seven eight nine ten eleven"


def run(spark, docs, items, **options):
    found = d.scan(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    digest = F.sha2(F.array_join("items", ","), 256)
    return sorted((tuple(r) for r in found.select(
        "doc_id", "n_words", "n_hit", F.size("items"), digest, "contaminated").collect()), key=str)


CASES = [
    (1, LONG), (2, LONG.upper() + " tail"), (3, "x " + LONG.replace(" ", "--") + " y"), (4, None), (5, ""), (6, " \n "),
    (7, "one two three"), (8, "alpha Straße beta"), (8, "alpha Straße beta"), (None, LONG), (9, LONG + " gap " + LONG),
    (10, "one two three four five six seven eight nine"), (11, "ÀB straße"),
]
ITEM_CASES = [(3, LONG), (20, LONG), (100, "straße"), (5, None), (6, ""), (7, "À b"), (3, "alpha straße"), (None, "tail")]


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 1, 200])
def test_cases(spark, block_bytes):
    expected = sorted(d.brute_force(CASES, ITEM_CASES), key=str)
    assert run(spark, CASES, ITEM_CASES, block_bytes=block_bytes) == expected


def test_blocks_over_shuffled_rows(spark):
    """Several blocks over an input whose rows come out of a shuffle, copies and clashing columns included."""
    docs = [(i, text) for i in range(40) for _, text in CASES]
    df = spark.createDataFrame(docs, DOCS).withColumns({"k0": F.lit(1), "r": F.lit("own")}).repartition(7)
    found = d.scan(df, spark.createDataFrame(ITEM_CASES, ITEMS), block_bytes=200)
    assert found.columns[:4] == ["doc_id", "text", "k0", "r"]
    digest = F.sha2(F.array_join("items", ","), 256)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.size("items"), digest, "contaminated").collect()), key=str)
    assert got == sorted(d.brute_force(docs, ITEM_CASES), key=str)


def test_a_large_set_is_built_in_seconds():
    rows = [(10, hash((i, 7)) >> 1, b"word " * 9 + str(i).encode(), ["1"]) for i in range(300_000)]
    begun = time.perf_counter()
    assert len(d.WindowSet(rows).items) == 300_000 and time.perf_counter() - begun < 10


def test_empty_tables(spark):
    assert run(spark, [], ITEM_CASES) == []
    assert [r[2] for r in run(spark, CASES, [])] == [0] * len(CASES)


def test_long_text_and_long_word(spark):
    docs = [(1, "w " * 400_000 + LONG), (2, "z" * 3_000_000 + " " + LONG), (3, "z" * 10)]
    assert run(spark, docs, ITEM_CASES) == sorted(d.brute_force(docs, ITEM_CASES), key=str)


def test_whole_table(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in d.op2_decontaminate(spark, SF).collect())
    assert got == sorted(d.brute_force(documents, items))


def test_removal(spark):
    docs = spark.createDataFrame([(1, "keep this", 7), (2, f"head {LONG}, tail", 8), (3, None, 9), (4, LONG, 1)],
                                 "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(1, LONG)], ITEMS)
    assert sorted(tuple(r) for r in d.remove(docs, items).collect()) == [(1, "keep this", 7), (3, None, 9)]
    cut = d.remove(docs, items, drop_share=0.9)
    assert sorted(tuple(r) for r in cut.collect()) == [(1, "keep this", 7), (2, "head , tail", 8), (3, None, 9)]
