"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is three records: request, response (or revisit) and metadata; the first and the last name the
second in WARC-Concurrent-To. Each record is a gzip member of its own. Spark's writer makes the files, so that
they lie in any store that Spark reaches, and a task that is run again leaves no half-written file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, table, written

#: Payloads of so many bytes or more are stored once.
REVISIT_BYTES = 1000
#: Bytes of a file, about: a file is read as one row. A record that has more is a file of its own.
FILE_BYTES = 16 << 20
#: Bytes of a gzip member before compression, at most; a longer record is several members.
MEMBER_BYTES = 8 << 20
_EOL = "\r\n"
RECORD = "record_id string, type string, target string, concurrent_to string, refers_to string, content_type string, payload_bytes bigint, payload_digest string, fields map<string,string>"


def _lines(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _record(kind, id, url, date: str, content_type: str, block, *more):
    head = _lines("WARC/1.1", _EOL, "WARC-Type: ", kind, _EOL, "WARC-Record-ID: ", id, _EOL, "WARC-Date: ", date, _EOL, "WARC-Target-URI: ", url, _EOL, *more, "Content-Type: ", content_type, _EOL, "Content-Length: ", F.octet_length(block).cast("string"), _EOL, _EOL)
    return F.concat(head, block)


def _uuid(digest):
    part = lambda a, n: F.substring(digest, a, n)
    return _lines("<urn:uuid:", part(1, 8), "-", part(9, 4), "-", part(13, 4), "-", part(17, 4), "-", part(21, 12), ">")


def write_archives(pages: DataFrame, path: str, id="page_id", url="url", html="html", date="1970-01-01T00:00:00Z", least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes a capture for each row of pages, as gzipped WARC/1.1 files of about file_bytes under path.

    The payload is the html in UTF-8, null as an empty one. Of captures whose payloads are equal and have
    `least` bytes, the one with the largest id is a response; the others are revisits that refer to it and
    hold no payload. Repeated rows are captures of their own; of repeated largest ids one is the response.
    White space and control characters in a url are written as %20; a null url is empty, a null id too. An
    empty table gives no records; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    row = F.monotonically_increasing_id()
    rows = pages.select(F.col(id).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_payload"), row.alias("_row"))
    rows = rows.withColumn("_bytes", F.octet_length("_payload")).withColumn("_key", F.sha2("_payload", 256))
    # Groups of one need no entry; hot groups are summed up before they are moved.
    groups = rows.filter(F.col("_bytes") >= least).groupBy("_key").agg(F.max(F.struct("_id", "_row")).alias("_last"), F.count(F.lit(1)).alias("_n"))
    groups = written(groups.filter("_n > 1").select(F.col("_key").alias("_of"), F.col("_last._row").alias("_first")), "warc-copies")
    rows = rows.join(groups, rows["_key"] == groups["_of"], "left")
    revisit = F.col("_first").isNotNull() & (F.col("_first") != F.col("_row"))
    own = lambda kind, n="_row": _uuid(F.md5(_lines(kind, F.col(n).cast("string")).cast("binary")))
    safe = F.regexp_replace("_url", "[\\x00-\\x20\\x7f]", "%20")
    host = F.regexp_extract(safe, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    size = F.col("_bytes").cast("string")
    http = _lines("HTTP/1.1 200 OK", _EOL, "Content-Type: text/html; charset=utf-8", _EOL, "Content-Length: ", size, _EOL, _EOL)
    with_ = _lines("WARC-Concurrent-To: ", own("response"), _EOL)
    digest = _lines("WARC-Payload-Digest: sha1:", F.sha1("_payload"), _EOL)
    refers = F.when(revisit, _lines("WARC-Refers-To: ", own("response", "_first"), _EOL, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", _EOL)).otherwise("")
    request = _record("request", own("request"), safe, date, "application/http;msgtype=request", _lines("GET ", safe, " HTTP/1.1", _EOL, "Host: ", host, _EOL, _EOL), with_)
    response = _record(F.when(revisit, "revisit").otherwise("response"), own("response"), safe, date, "application/http;msgtype=response", F.when(revisit, http).otherwise(F.concat(http, "_payload")), digest, refers)
    metadata = _record("metadata", own("metadata"), safe, date, "application/warc-fields", _lines("page-id: ", F.coalesce(F.col("_id").cast("string"), F.lit("")), _EOL, "payload-bytes: ", size, _EOL), with_)

    def run(batches):
        size, n = 0, 0
        for batch in batches:
            out = []
            for value in batch.column(0):
                data = value.as_buffer().to_pybytes() + b"\r\n\r\n"
                members = [member(data[a : a + MEMBER_BYTES]) for a in range(0, len(data), MEMBER_BYTES)]
                out += [(size // file_bytes, n + k, m) for k, m in enumerate(members)]
                size, n = size + sum(map(len, members)), n + len(members)
                if size // file_bytes != out[0][0]:
                    yield records(out)
                    out = []
            if out:
                yield records(out)

    def records(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["file", "n", "value"])

    members = rows.select(F.explode(F.array(request, response, metadata)).alias("value")).mapInArrow(run, "file bigint, n bigint, value binary")
    # A member ends with its size, whose last byte is 0: that byte is the writer's line separator.
    members = members.sortWithinPartitions("file", "n").select("file", F.col("value").cast("string").alias("value"))
    members.write.partitionBy("file").option("lineSep", "\0").text(path)


def member(data: bytes) -> bytes:
    """A gzip member without its last byte, which is 0 for data of under 16 MB."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        raise ValueError(f"{len(data)} bytes are too many for a member")
    return out[:-1]


def inflated(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of a plain one, in pieces of bounded size."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[a : a + step]) for a in range(0, len(data), step))
        return
    at, unpacker, rest = 0, zlib.decompressobj(31), b""
    while at < len(data) or rest:
        piece = rest or data[at : at + step]
        at += 0 if rest else len(piece)
        yield unpacker.decompress(piece, step)
        rest = unpacker.unconsumed_tail
        if unpacker.eof:
            at -= len(unpacker.unused_data)
            unpacker = zlib.decompressobj(31)
    if tail := unpacker.flush():
        yield tail


def parse(pieces: Iterable[bytes]):
    """(headers by lower-case name, block) of each record of an archive, given in pieces; ValueError where they aren't records."""
    held, at, done, need, head, start = bytearray(), 0, 0, 0, None, 0
    for piece in pieces:
        held += piece
        while len(held) - at >= need:
            if head is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0 or not held.startswith(b"WARC/1.", at):
                    if len(held) - at >= 7 and not held.startswith(b"WARC/1.", at):
                        raise ValueError(f"no WARC record at byte {done + at}")
                    break
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[at:end].decode().split(_EOL)[1:])}
                start = end + 4 - at
                need = start + int(head["content-length"]) + 4
            else:
                stop = at + need - 4
                if held[stop : stop + 4] != b"\r\n\r\n":
                    raise ValueError(f"the record at byte {done + at} doesn't end where its length says")
                yield head, bytes(held[at + start : stop])
                at, need, head = at + need, 0, None
        del held[:at]
        done, at = done + at, 0
    if held:
        raise ValueError(f"no whole WARC record at byte {done}")


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The archives' records, a row each; payloads adds the responses' payload (binary).

    payload_bytes and payload_digest (bare lower-case hex SHA-1) are computed from what was read; a
    digest that differs from the record's own header is an error. A revisit, which has no payload, gets
    the digest that its header gives, and null bytes. fields has the lines of a warc-fields block. A worker
    holds a file as it is stored and a record of it at a time; Spark reads files of up to 2 GB.
    """
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads
    small_batches(spark)

    def row(head, block):
        kind, digest, size, body, fields = head["warc-type"], None, None, None, None
        if kind == "response":
            body = block[block.index(b"\r\n\r\n") + 4 :]
            digest, size = hashlib.sha1(body).hexdigest(), len(body)
        given = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if digest and given and digest != given:
            raise ValueError(f"{head['warc-record-id']}: the payload isn't what its digest says")
        if head.get("content-type") == "application/warc-fields":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split(_EOL) if x)]
        out = (head["warc-record-id"], kind, head.get("warc-target-uri"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("content-type"), size, digest or given, fields)
        return (*out, body) if payloads else out

    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * payloads

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in parse(inflated(memoryview(data.as_buffer()))):
                    rows.append(row(head, block))
                    size += len(block) if payloads else 0
                    if len(rows) == 1000 or size > MEMBER_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD + ", payload binary" * payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target, and the structs response, request, metadata.

    A request or metadata record belongs to the response or revisit that its WARC-Concurrent-To names; a
    capture without one of them has it null. Of several of a kind the first by record id is taken.
    Records that name no known response are left out. Empty records give no captures.
    """
    main = records.filter(F.col("type").isin("response", "revisit"))
    capture = main.select(F.col("record_id").alias("capture_id"), "target", F.struct(*main.columns).alias("response"))
    others = records.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    pick = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("record_id", "content_type", F.to_json("fields").alias("fields")))).alias(kind)
    joined = others.groupBy(F.col("concurrent_to").alias("capture_id")).agg(pick("request"), pick("metadata"))
    out = capture.join(joined, "capture_id", "left")
    metadata = F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.record_id").alias("record_id"), F.from_json("metadata.fields", "map<string,string>").alias("fields")))
    return out.select("capture_id", "target", "response", F.col("request").dropFields("fields").alias("request"), metadata.alias("metadata"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(written(read_records(spark, path), "warc-records"))  # assemble reads them twice
    id, r = F.col("metadata.fields")["page-id"].try_cast("bigint"), "response."
    rows = written(captures.select("capture_id", id.alias("page_id"), F.col(r + "type").alias("record_type"), F.col(r + "payload_digest").alias("payload_digest"), F.coalesce(r + "payload_bytes", F.col("metadata.fields")["payload-bytes"].cast("bigint")).alias("payload_bytes"), F.coalesce(r + "refers_to", "capture_id").alias("_to")), "captures")
    # A response refers to itself here, so that no null is a hot key.
    named = rows.filter("record_type = 'response'").select(F.col("capture_id").alias("_to"), F.col("page_id").alias("_page"))
    out = rows.join(named, "_to")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("_page")).alias("refers_to"))


OP2_SQL = """
SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS payload_digest,
       CASE WHEN strlen(p) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS p FROM pages)
WINDOW w AS (PARTITION BY p)
"""
