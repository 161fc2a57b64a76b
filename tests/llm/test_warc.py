import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import warc as w
from tidemill.session import scratch_path

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
ROWS = [
    (0, "http://x/0", "a" * 150), (1, "u", None), (2, "u", ""), (3, "u", "b" * 99), (4, "u", "b" * 99), (5, "u", "é" * 60_000),
    (6, "u", "x\r\n\r\ny" * 9000), (7, "u", "a" * 150), (8, None, "a" * 150), (2, "u\r\nX: 1", "zz"), (2, "u", "zz"),
    (None, None, "a" * 150), (None, "n", "c" * 200), (9, "u", "0\r\n\r\n" * 40), (10, "u", "d" * w.CHUNK), (11, "u", "e" * (w.CHUNK + 1)),
    (12, "u", "f" * w.SEGMENT * 3), (5, "again", "é" * 60_000),
]


def expected(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        refers = first.get(body) if body in first and first[body] != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers, True))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]


@pytest.mark.parametrize("chunk, segment", [(w.CHUNK, w.SEGMENT), (7, 64), (100_000, 1000)])
def test_round_trip(spark, chunk, segment):
    rows = [r for r in ROWS if segment > 64 or len(r[2] or "") < 2000]
    path = scratch_path(spark, "warc")
    w.write(spark.createDataFrame(rows, PAGES).repartition(3).withColumn("payload", F.lit(1)), path, chunk, segment)
    found = w.read(spark, path).cache()
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str) == expected(rows)
    whole = found.filter("record_type = 'response'").collect()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in whole)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in w.op1_warc(spark, SF).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    path = scratch_path(spark, "warc")
    w.write(spark.createDataFrame([], PAGES), path)
    assert w.read(spark, path).collect() == []


def record(kind, name, block, **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items())]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\nhello\r\n3\r\n wo\r\n0\r\nTrailer: y\r\n\r\n"
    cut = [message[:30], message[30:60], message[60:]]

    def parts(name, number, total=len(message), order=(1, 0, 2), skip=()):
        made = [record("response", name, cut[0], WARC_Segment_Number=1, X_Page_Id=number)]
        for k in (1, 2):
            more = {"WARC_Segment_Total_Length": total} if k == 2 else {}
            made.append(record("continuation", f"{name}-{k}", cut[k], WARC_Segment_Origin_ID=name, WARC_Segment_Number=k + 1, **more))
        return [made[k] for k in order if k not in skip]

    files = [
        [record("warcinfo", "<i>", b"software: x\r\n"), *parts("<a>", 1)[:2]], parts("<a>", 1)[2:],
        parts("<b>", 2, total=5), parts("<c>", 3, skip=(1,)), parts("<d>", 4, order=(2, 1, 0, 1)),
        [record("response", "<e>", b"HTTP/1.1 200 OK\r\n\r\nplain", X_Page_Id=5),
         record("response", "<f>", message[:-20], X_Page_Id=6)],
    ]
    for i, blocks in enumerate(files):
        data = b"".join(gzip.compress(x) for x in blocks) if i % 2 else b"".join(blocks)
        (tmp_path / f"{i}.warc{'.gz' * (i % 2)}").write_bytes(data)
    rows = {r.page_id: (r.payload, r.intact) for r in w.read(spark, str(tmp_path)).collect()}
    good = bytearray(b"hello wo")
    assert rows == {1: (good, True), 2: (None, False), 3: (None, False), 4: (good, True), 5: (bytearray(b"plain"), True),
                    6: (None, False)}


@pytest.mark.parametrize("data", [b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.0\r\nContent-Le", b"text\r\n\r\n"])
def test_broken_archives_raise(data):
    with pytest.raises(ValueError):
        list(w.records(iter([data])))
