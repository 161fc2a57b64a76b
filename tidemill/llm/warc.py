"""WARC archives: writing with revisits, chunked transfer framing and segments; reading with reassembly.

Writing is column expressions and Spark's text writer, whose line separator is the end of a WARC record; files are
gzip and hold at most ``RECORDS_PER_FILE`` records. An HTTP message longer than ``SEGMENT`` bytes is cut: its first
record has segment number 1, continuation records name that record as their origin, and the last one tells the total.

Reading parses each file as a stream, so a task holds one record at a time. Whole records are decoded where they are
read. Only segments are shuffled: they are grouped by origin, put in order and checked against the total length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table
from tidemill.session import scratch_path

CRLF = "\r\n"
CHUNK, SEGMENT = 8192, 32768
RECORDS_PER_FILE = 4096
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"

PAGE = ("page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "intact boolean, payload binary")


def _chunked(payload: Column, chunk: int) -> Column:
    """The body in chunked transfer framing."""
    n = F.octet_length(payload)
    piece = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda i: F.concat(
        F.lower(F.hex(F.least(F.lit(chunk), n - i * chunk))), F.lit(CRLF),
        F.substring(payload, i * chunk + 1, F.lit(chunk)).cast("string"), F.lit(CRLF)))
    return F.concat(F.when(n > 0, F.array_join(piece, "")).otherwise(""), F.lit(f"0{CRLF}{CRLF}"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, path: str, chunk: int = CHUNK, segment: int = SEGMENT) -> None:
    """A record per row of ``pages`` (page_id, url, html) to gzip archives under ``path``.

    Of rows with the same payload of at least 100 bytes, those with the smallest page_id are responses and the others
    revisits of it. Null html is an empty payload. A null page_id comes after all others and has no header.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.col("url").cast("string"), r"\p{Cntrl}", "").alias("uri"),
                        payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    copies = rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(copies, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("refers", F.when(again, F.col("first")))
    line = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    message = F.when(F.col("refers").isNotNull(), F.concat(
        F.lit(f"{line}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))).otherwise(
        F.concat(F.lit(f"{line}Transfer-Encoding: chunked{CRLF * 2}"), _chunked(F.col("payload"), chunk)))
    number = F.monotonically_increasing_id()
    rows = rows.select(
        "page_id", "uri", "digest", "refers", message.cast("binary").alias("message"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"),
                 number.cast("string"), F.lit(">")).alias("id"))
    n = F.octet_length("message")
    parts = F.greatest(F.ceil(n / segment), F.lit(1)).cast("int")
    cut = rows.withColumn("total", n).withColumn("parts", parts).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    cut = cut.withColumn("block", F.substring("message", (F.col("part") - 1) * segment + 1, F.lit(segment)))
    several, first = F.col("parts") > 1, F.col("part") == 1
    kind = F.when(~first, "continuation").when(F.col("refers").isNotNull(), "revisit").otherwise("response")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.when(first, F.col("id")).otherwise(
            F.concat(F.substring("id", F.lit(1), F.length("id") - 1), F.lit("#"), F.col("part").cast("string"), F.lit(">")))),
        _header("WARC-Date", F.lit(DATE)), _header("WARC-Target-URI", F.col("uri")),
        _header("X-Page-Id", F.col("page_id")),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        _header("WARC-Profile", F.when(first & F.col("refers").isNotNull(), F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("X-Refers-To-Page-Id", F.when(first, F.col("refers"))),
        _header("WARC-Segment-Number", F.when(several, F.col("part"))),
        _header("WARC-Segment-Origin-ID", F.when(several & ~first, F.col("id"))),
        _header("WARC-Segment-Total-Length", F.when(several & (F.col("part") == F.col("parts")), F.col("total"))),
        _header("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _header("Content-Length", F.octet_length("block")), F.lit(CRLF), F.col("block").cast("string"))
    cut.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip") \
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _unzipped(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of a plain file, in pieces."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    while len(view):
        member, rest = zlib.decompressobj(31), b""
        while len(view) and not member.eof:
            piece, view = view[:step], view[step:]
            data = member.decompress(piece, 4 * step)
            while data:
                yield data
                data = member.decompress(member.unconsumed_tail, 4 * step) if member.unconsumed_tail else b""
            rest = member.unused_data
        if rest:
            view = memoryview(content)[len(content) - len(view) - len(rest):]


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a stream."""
    held, ended = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(pieces, None)
            if piece is None:
                ended = True
            else:
                held.extend(piece)
        return len(held) >= n

    while True:
        while fill(4) and held[:2] == b"\r\n":
            del held[:2]
        if not held.strip():
            return
        looked = 0
        while (at := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("an archive ends within the headers of a record")
        lines = held[:at].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        del held[:at + 4]
        if not fill(size):
            raise ValueError("an archive ends within the block of a record")
        block = bytes(held[:size])
        del held[:size]
        yield headers, block


def _number(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def _task(schema: pa.Schema, rows_of):
    """A task function over file contents: ``rows_of`` gives the rows of a record, batches hold some 4 MB."""

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in records(_unzipped(content.as_py())):
                    for row in rows_of(headers, block):
                        rows.append(row)
                        size += len(row[-1] or b"") + 1000
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


HEADERS = pa.map_(pa.string(), pa.string())


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path`` as it stands: type, record_id, headers, block."""
    schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("headers", HEADERS), ("block", pa.binary())])

    def rows(headers, block):
        yield headers.get("warc-type"), headers.get("warc-record-id"), list(headers.items()), block

    return _files(spark, path).mapInArrow(
        _task(schema, rows), "type string, record_id string, headers map<string,string>, block binary")


def dechunked(body: bytes) -> bytes | None:
    """The body without its chunked framing; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[end + 2 + size:end + 4 + size] != b"\r\n":
            return None
        parts.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def decode(headers: dict[str, str], message: bytes | None) -> tuple:
    """One row of PAGE from the headers of a record and its whole HTTP message (None: not all segments are there)."""
    head, _, body = (message or b"").partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    page, refers = _number(headers, "x-page-id"), _number(headers, "x-refers-to-page-id")
    uri, kind = headers.get("warc-target-uri"), headers.get("warc-type")
    if kind == "revisit":
        size = int(fields["content-length"]) if "content-length" in fields else None
        return page, uri, size, digest, kind, refers, message is not None, None
    if message is not None and "chunked" in fields.get("transfer-encoding", "").lower():
        body = dechunked(body)
    if message is None or body is None:
        return page, uri, None, None, kind, refers, False, None
    own = hashlib.sha256(body).hexdigest()
    return page, uri, len(body), own, kind, refers, not digest or own == digest, body


def _joined(parts: list[dict], total: int | None) -> bytes | None:
    """The message of all segments in order; None if one is missing or the length is wrong."""
    once = {p["segment"]: p["block"] for p in parts}
    message = b"".join(once[k] for k in sorted(once))
    return message if sorted(once) == list(range(1, len(once) + 1)) and len(message) == total else None


PAGE_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def _whole(payload: bool):
    """Pages of the records that are in one piece."""
    def rows(headers, block):
        if "warc-segment-number" not in headers and headers.get("warc-type") in ("response", "revisit", "resource"):
            row = decode(headers, block)
            yield row if payload else (*row[:-1], None)

    return _task(PAGE_SCHEMA, rows)


def _segments(headers, block):
    """Segments, by the record that they belong to; only the first one's headers go along."""
    if (number := _number(headers, "warc-segment-number")) is not None:
        origin = headers.get("warc-segment-origin-id", headers.get("warc-record-id"))
        yield (origin, list(headers.items()) if number == 1 else None, _number(headers, "warc-segment-total-length"),
               number, block)


def _reassembled(payload: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for headers, parts, total in zip(*batch.columns, strict=True):
                row = decode(dict(headers.as_py() or []), _joined(parts.as_py(), total.as_py()))
                rows.append(row if payload else (*row[:-1], None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PAGE_SCHEMA.types, strict=True)], schema=PAGE_SCHEMA)

    return run


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The pages of the archives under ``path``: segments put together, chunked framing decoded, digests checked.

    ``intact`` is false where a segment or part of the total length is missing, the framing is broken or the digest
    differs; without all its parts a record has null bytes and digest. A segment that is there twice counts once.
    Archives without records give an empty result. Records other than responses, revisits and resources are passed over.
    Without ``payload`` the column is null and no body leaves its task.
    """
    files = _files(spark, path)
    schema = pa.schema([("origin", pa.string()), ("headers", HEADERS), ("total", pa.int64()), ("segment", pa.int32()),
                        ("block", pa.binary())])
    parts = files.mapInArrow(
        _task(schema, _segments), "origin string, headers map<string,string>, total long, segment int, block binary")
    cut = parts.groupBy("origin").agg(
        F.max(F.to_json("headers")).alias("headers"), F.collect_list(F.struct("segment", "block")).alias("parts"),
        F.max("total").alias("total")).select(F.from_json("headers", "map<string,string>").alias("headers"), "parts", "total")
    return files.mapInArrow(_whole(payload), PAGE).unionByName(cut.mapInArrow(_reassembled(payload), PAGE))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, read back from the archives: ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``intact``."""
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
