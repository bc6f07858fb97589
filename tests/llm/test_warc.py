import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest

from shardloom.llm import warc as WA

SCHEMA = "page_id bigint, url string, html string, _row string, type int"
BIG = "é\r\n\r\nWARC/1.1\r\n" * 100


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.org/x y\r\nz", BIG), (2, None, BIG), (5, "http://b.org", BIG), (3, "http://c.org/é", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "z" * 2000), (8, "u", "y" * 300_000), (9, "u", "w" * 1500), (9, "u", "w" * 1500), (10, "u", "q" * 999), (11, "u", "q" * 999)]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)


def test_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    WA.write_archives(pages, path, file_bytes=1000)
    files = [*Path(f"{tmp_path}/w").glob("file=*/part-*")]
    assert len(files) > 3 and all(f.stat().st_size < 4000 for f in files)
    heads = [h for f in files for h, _ in WA.parse([gzip.decompress(f.read_bytes())])]
    assert all(len([*members(f.read_bytes())]) == sum(1 for _ in WA.parse([gzip.decompress(f.read_bytes())])) for f in files)
    assert len(heads) == 39 == len({h["warc-record-id"] for h in heads})
    captures = WA.assemble(WA.read_records(spark, path, payloads=True)).collect()
    assert len(captures) == 13
    want = sorted([(r.page_id or 0, (r.html or "").encode()) for r in pages.collect()])
    by = {c.capture_id: c.response.payload for c in captures}
    got = sorted((int(c.metadata.fields["page-id"] or 0), bytes(by[c.response.refers_to or c.capture_id])) for c in captures)
    assert got == want
    assert all(c.request.content_type.endswith("request") for c in captures)


def members(data):
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        assert d.eof
        data = d.unused_data


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_pieces_of_any_size(step):
    records = [f"WARC/1.1\r\nWARC-Type: x{i}\r\nContent-Length: {n}\r\n\r\n".encode() + b"z" * n for i, n in enumerate((0, 5, 3000))]
    plain = b"".join(r + b"\r\n\r\n" for r in records)
    each = b"".join(WA.member(r + b"\r\n\r\n") + b"\0" for r in records)
    for data in (plain, gzip.compress(plain), each):
        got = [(h["warc-type"], len(b)) for h, b in WA.parse(WA.inflated(memoryview(data), step))]
        assert got == [("x0", 0), ("x1", 5), ("x2", 3000)]
    with pytest.raises(ValueError):
        [*WA.parse(WA.inflated(memoryview(each[:-40]), step))]
    assert [*WA.parse(WA.inflated(memoryview(b"")))] == []


def test_a_page_of_20_mb(spark, tmp_path):
    rng = random.Random(1)
    html = "".join(rng.choices("abcdefghijklmnop", k=1 << 20)) * 20
    WA.write_archives(spark.createDataFrame([(1, "u", html), (2, "u", "b")], "page_id bigint, url string, html string"), f"file://{tmp_path}/w")
    got = {r.payload_bytes: r for r in WA.read_records(spark, f"file://{tmp_path}/w", payloads=True).filter("type = 'response'").collect()}
    assert bytes(got[20 << 20].payload) == html.encode() and bytes(got[1].payload) == b"b"


def test_op2(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in WA.op2_warc(spark, str(tmp_path)).collect())
    size = len(BIG.encode())
    assert [r[:4] for r in rows if r[0] in (1, 2, 5)] == [(1, "revisit", 5, size), (2, "revisit", 5, size), (5, "response", None, size)]
    assert [r[1:3] for r in rows if r[0] == 9] == [("response", None), ("revisit", 9)]
    assert {r[1] for r in rows if r[0] in (0, 3, 4, 6, 7, 8, 10, 11)} == {"response"}
    assert next(r for r in rows if r[0] == 6)[3:] == (0, hashlib.sha1(b"").hexdigest())
    pages.limit(0).write.parquet(f"{tmp_path}/e/pages.parquet")
    assert WA.op2_warc(spark, f"{tmp_path}/e").count() == 0


def test_broken_archives():
    for bad in (b"x", b"WARC/1.1\r\ncontent-length: 9\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(ValueError):
            list(WA.parse([bad]))
