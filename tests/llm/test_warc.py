import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kestrelgrid.llm import warc

BODY = "é" * 700 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.0\r\n\r\n\r\n\r\nWARC/1." + "<p>日本</p>" * 90


def pages(spark, rows=None):
    rows = rows if rows is not None else [
        (1, "http://a.example/", BODY), (2, None, BODY), (3, "http://b.example/ x\r\ny", ""), (4, "u", None), (5, "u", "short"), (5, "u", "short"), (None, "u", "short"), (None, "v", "alone"), (6, "u", "\r\n\r\n"), (-7, "u", BODY + "!"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("payload", "id", "tag", "chunk")})


def plain(rows, least=0):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        revisit = len(body) >= least and first is not None and (page is None or page < first)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [16, 7, 64 * 1024])
@pytest.mark.parametrize("least", [0, 6])
def test_round_trip_of_hard_rows(spark, chunk, least):
    df = pages(spark)
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, min_bytes=least, chunk=chunk).collect()], key=str)
    assert got == plain([(r.page_id, r.url, r.html) for r in df.collect()], least)


def test_chunks_join_to_the_payload_and_carry_its_digest(spark):
    path = warc.write_warc(pages(spark), chunk=100)
    rows = [r for r in warc.read_warc(spark, path).collect() if r.key == 2]
    rows.sort(key=lambda r: r.chunk_no)
    so_far = b""
    for k, r in enumerate(rows):
        so_far += r.chunk
        assert (r.chunk_no, r.chunks, r.running_bytes) == (k, len(rows), len(so_far))
        assert len(r.chunk) <= 100
        assert r.running_digest == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
    assert so_far == BODY.encode()


def test_archives_follow_the_format(spark):
    path = warc.write_warc(pages(spark), chunk=100)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file://")).glob("part-*"))
    n, ids = 0, set()
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        h = dict(line.split(b": ", 1) for line in lines[1:])
        assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= set(h)
        end = int(h[b"Content-Length"])
        assert rest[end : end + 4] == b"\r\n\r\n"
        ids.add(h[b"WARC-Record-ID"])
        data = rest[end + 4 :]
        n += 1
    assert n > 20 and len(ids) >= n - 1


def test_a_changed_archive_is_refused(spark, tmp_path):
    path = warc.write_warc(pages(spark).where("page_id = 2"), chunk=100)
    source = [p for p in Path(path.removeprefix("file://")).glob("part-*") if b"WARC" in gzip.decompress(p.read_bytes())][0]
    data = gzip.decompress(source.read_bytes())
    (tmp_path / "a.gz").write_bytes(gzip.compress(data.replace("é".encode(), "è".encode(), 1)))
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_warc(spark, str(tmp_path)).collect()
    at = data.index(b"WARC/1.1", 10)
    (tmp_path / "a.gz").write_bytes(gzip.compress(data[at:]))
    with pytest.raises(Exception, match="out of order"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_archives_of_other_writers(spark, tmp_path):
    def record(version, kind, name, block, *more):
        head = [f"WARC/{version}", f"WARC-Type:{kind}", f"WARC-Record-ID: <urn:{name}>", f"content-length: {len(block)}", *more]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"\r\n\r\nWARC/1.0\r\n\r\n" * 300 + b"\xff\x00end\r\n"
    http = "Content-Type: application/http; msgtype=response"
    info, page = record("1.0", "warcinfo", "a", b"software: x\r\n"), record("1.0", "response", "b", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + body, http, "WARC-Target-URI: http://a/")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))  # a member a record
    (tmp_path / "b.warc").write_bytes(record("1.1", "resource", "c", b"") + record("1.1", "response", "d", b"HTTP/1.1 200\r\n\r\n", http))
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert {k: (r.record_type, bytes(r.chunk), r.uri, r.key) for k, r in got.items()} == {
        "<urn:a>": ("warcinfo", b"software: x\r\n", None, None), "<urn:b>": ("response", body, "http://a/", None), "<urn:c>": ("resource", b"", None, None), "<urn:d>": ("response", b"", None, None),
    }
    assert got["<urn:b>"].running_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    (tmp_path / "b.warc").write_bytes(record("1.1", "resource", "c", b"abc")[:-5])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, str(tmp_path / "b.warc")).collect()


def test_the_driver_s_pages_reach_several_chunks(spark):
    from ..oracle import DATA

    longest = spark.read.parquet(f"{DATA}/../sf0.01/pages.parquet").agg(F.max(F.octet_length("html"))).first()[0]
    assert longest > warc.CHUNK


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
