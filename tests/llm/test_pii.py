import brute
import pytest
from pyspark.sql import functions as F

from tidemill.llm import pii

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", "mail a@b.co, x@y, a.b+c@d-e.f.g. @z.de a@b..c", "é a@b.com_x@y.org😀 q@r.st", "a@b.c@d.e f@g.h.i@j.k",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.0255 999.1.1.1.1 1.2.3 1.2.3.4.5.6.7.8 0000000255.0.0.0",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111, 41111111111111111111 5500005555555559 1",
    "0 4111111111111111 79927398713 6011000990139424-", "+49 (0)30 1234567 +1 23 + 1234567890 +1-800-555-0199. ++4420 7946 0958)",
    "+1234567890123456 +123456789 x+4420", "😀😀 +1 (743) 555-3824 é 10.0.0.1 z@é.de",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE00370400440532013000",
    "my ssn is 078-05-1120 but 123-45-6789 stands far away from any such word, and so it is not taken as one of them",
    "a" * 50_000, "1" * 50_000, "1." * 20_000, "a." * 20_000 + "@", "+" + "1 " * 20_000, "1 " * 20_000,
    "a@" + "b." * 20_000 + "c",
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def base(df):
    columns = [(k.name, F.col(k.name)) for k in pii.KINDS if k.base]
    found = pii.find(df).select("doc_id", *(F.size(c).cast("long") for _, c in columns), F.sha2(pii._listed(columns), 256))
    return [tuple(r) for r in found.orderBy("doc_id").collect()]


def test_cases(spark):
    assert base(docs(spark, TEXTS)) == [brute.pii(i, t) for i, t in enumerate(TEXTS)]


def test_whole_table(spark, documents):
    got = sorted(tuple(r)[:6] for r in pii.op3_pii(spark, SF).collect())
    assert got == sorted(brute.pii(*d) for d in documents)


def test_added_kinds(spark):
    rows = pii.find(docs(spark, TEXTS[11:13])).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in rows[0].iban] == [(5, 32), (37, 59)]
    assert [(s.start, s.end) for s in rows[1].ssn] == [(10, 21)]


def cut(spark, texts, kind):
    rows = pii.find(docs(spark, texts)).orderBy("doc_id").collect()
    return [[t[s.start:s.end] for s in r[kind]] for t, r in zip(texts, rows, strict=True)]


def test_account_ends(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    other = "ZZ" + f"{98 - int('3704004405320130003535' + '00') % 97:02d}" + " 3704 0044 0532 0130 00"
    texts = [f"{de} BIC COBADEFFXXX", f"{de} EUR 50", f"é {de} {gb} {no} Then", f"😀{de.replace(' ', '')} AND {gb},", f"AB12 {de}",
             f"{other} EUR 50", f"{de}x {de}X", f"{de[:-1]}1 BIC", "AB12 " * 20_000, "AB12" + "A" * 50_000]
    assert cut(spark, texts, "iban") == [
        [de], [de], [de, gb, no], [de.replace(" ", ""), gb], [de], [other], [], [], [], []]
    scores = [s.score for s in pii.find(docs(spark, [f"IBAN {de} EUR " + "x" * 60 + f" {gb}"])).first().iban]
    assert scores == [pytest.approx(1.0), pytest.approx(0.8)]
    red = pii.redact(docs(spark, texts[:2])).orderBy("doc_id").collect()
    assert [r.text for r in red] == ["[IBAN] BIC COBADEFFXXX", "[IBAN] EUR 50"]


def test_context_of_a_list(spark):
    a, b, c = "123-45-6789", "234-56-7890", "345-67-8901"
    texts = [f"SSN: {a}, {b}, {c}", f"{a}; {b} and {c} are social security numbers", f"ssn {a} (he), {b} (she)",
             f"ssn {a} {b}", f"{a}, {b}", f"{a} x {b}, ssn {c}", "SSN " + f"{a}, " * 500]
    assert cut(spark, texts, "ssn") == [[a, b, c], [a, b, c], [a, b], [a, b], [], [b, c], [a] * 500]


def test_scores_follow_context(spark):
    text = "tarjeta 4111111111111111 " + "x" * 60 + " 4111111111111111"
    scores = [s.score for s in pii.find(docs(spark, [text])).first().card]
    assert scores == [pytest.approx(1.0), pytest.approx(0.7)]


def test_redaction(spark):
    texts = ["é a@b.com und +49 30 1234567!", "clean", None, "4111 1111 1111 1111", "1.2.3.4 " * 300]
    df = docs(spark, texts).withColumn("n_chars", F.length("text")).withColumn("email", F.lit(5))
    rows = pii.redact(df).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["é [EMAIL] und [PHONE]!", "clean", None, "[CARD]", "[IP] " * 300]
    assert [r.n_chars for r in rows] == [22, 5, None, 6, 1500]
    assert {r.email for r in rows} == {5}


def test_redaction_leaves_nothing(spark):
    rows = pii.redact(spark.read.parquet(f"{SF}/documents.parquet"))
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows.filter(F.length("text") != F.col("n_chars")).isEmpty()


def test_empty_table(spark):
    assert base(docs(spark, [])) == []
    assert pii.redact(docs(spark, [])).collect() == []
