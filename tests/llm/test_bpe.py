import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import bpe
from tidemill.llm.words import text_buffer

SF = "/root/testdata/sf0.001"
PARTS = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'LL", "<|endoftext|>", "<|end", "1", "٣", "é", "漢", "😀",
         "\u0000", "\u0085", "\u001c", " ", "‍", "՘", "꟎", "࢏", "\U00011b0a"]


@pytest.fixture(scope="module")
def codec():
    with open(bpe.vocabulary_path(), "rb") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def column(codec, texts):
    ids, at = codec.encode_column(*text_buffer(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def pieces(codec, text):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = [*codec.starts(points, np.array([0])).tolist(), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def merged_by_scan(symbols, pairs):
    """The same merges, by looking at all pairs each time."""
    symbols = list(symbols)
    while found := [(*pairs[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a << 32 | b in pairs]:
        _, new, at = min(found, key=lambda x: (x[0], x[2]))
        symbols[at:at + 2] = [new]
    return symbols


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), unique=True, max_size=12))
def test_root_is_the_leftmost_lowest_pair(symbols, merges):
    pairs = {a << 32 | b: (rank, 4 + rank) for rank, (a, b) in enumerate(merges)}
    want = merged_by_scan(symbols, pairs)
    assert bpe.merge_lowest(symbols, pairs) == want
    others = [[], [1], symbols[:3], symbols]
    assert [x.tolist() for x in bpe.merge_many(others, bpe.Pairs(pairs))] == [merged_by_scan(o, pairs) for o in others]


def test_forgotten_pretokens_come_back(codec, library, monkeypatch):
    monkeypatch.setattr(codec, "known", bpe.Known(4))
    for text in ("a few words and some more of them", "others stand here", "a few words again of them", "x" * 500, " y".join("abcdefghij")):
        assert column(codec, [text, "them again", text])[2] == library.encode(text).ids


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map("".join) | st.text(max_size=20), max_size=6))
def test_as_the_library(codec, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert column(codec, texts) == want
    for text, some in zip(texts, want, strict=True):
        assert codec.encode(text) == some and codec.decode(some) == text == library.decode(some, skip_special_tokens=False)


def test_hashes_are_never_zero_and_tables_hold_what_they_got():
    known, rnd = bpe.Known(10), np.random.default_rng(2)
    hashes = np.unique(rnd.integers(1, 1 << 20, 500).astype(np.uint64))
    known.add(hashes, [np.full(i % 3, i, np.uint32) for i in range(len(hashes))])
    slots = known.find(hashes)
    assert (known.keys[slots] == hashes).all() and (known.n[slots] == np.arange(len(hashes)) % 3).all()
    assert (known.find(hashes + np.uint64(1 << 40)) == -1).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=12))
def test_decodes_any_ids(codec, library, some):
    assert codec.decode(some) == library.decode(some, skip_special_tokens=False)


def test_young_code_points_split_as_in_the_library(codec, library):
    """Code points that this Python's table lacks: every 97th and all below the astral planes."""
    for c in (c for c in range(0x378, 0x110000) if unicodedata.category(chr(c)) == "Cn" and (c < 0x10000 or c % 97 == 0)):
        text = f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)}"
        assert pieces(codec, text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_one_long_pretoken(codec, library):
    text = "abc" * 40_000
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, documents, library):
    got = {r.doc_id: r for r in bpe.op13_bpe(spark, SF).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        want = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_clashing_columns_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (None, "two words")], "id long, text string") \
        .withColumn("IDS", F.lit("own")).withColumn("value", F.lit(7)).withColumn("0", F.lit("zero"))
    out = bpe.encode(df)
    assert out.columns == ["id", "text", "value", "0", "ids"]
    want = library.encode("two words").ids
    assert sorted(((r.id, r.ids) for r in out.collect()), key=str) == sorted([(1, []), (2, []), (3, want), (None, want)], key=str)
    back = bpe.decode(out.withColumn("ids", F.when(F.col("id") != 2, F.col("ids"))))
    assert sorted(r.decoded for r in back.collect()) == ["", "", "", "two words"]
    assert bpe.encode(df.limit(0)).collect() == [] and bpe.decode(bpe.encode(df).limit(0)).collect() == []


def test_other_vocabularies_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        with open(bpe.vocabulary_path("word_bpe_49k.json"), "rb") as f:
            bpe.Codec(f.read())
