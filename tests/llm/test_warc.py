"""Archives that the writer did not make: members, lenient headers, other record types, broken records."""

from __future__ import annotations

import gzip
import hashlib

from dealgrid.llm import warc


def record(kind, block, *headers, sep=b": ", nl=b"\r\n", length=None):
    fields = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<urn:x:%d>" % (len(block) + 7 * len(headers))), *headers, (b"Content-Length", b"%d" % (len(block) if length is None else length))]
    return b"WARC/1.0" + nl + b"".join(k + sep + v + nl for k, v in fields) + nl + block + nl + nl


HTTP = (b"Content-Type", b"application/http; msgtype=response")


def page(n):
    return (b"Page-Id", b"%d" % n)


def read(spark, folder):
    return {r.page_id: (r.record_type, r.status, None if r.payload is None else bytes(r.payload), r.payload_bytes) for r in warc.read_archives(spark, str(folder)).collect()}


def test_every_member_is_read(spark, tmp_path):
    body = lambda t: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + t
    members = [record(b"warcinfo", b"software: x\r\n", page(1)), record(b"request", b"GET / HTTP/1.1\r\n\r\n", page(2), HTTP), record(b"response", body(b"<p>one"), page(3), HTTP)]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, members)) + b"\0" * 10)
    (tmp_path / "plain.warc").write_bytes(record(b"response", body(b"two"), page(4), HTTP) + record(b"metadata", b"k: v", page(5)))
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    assert read(spark, tmp_path) == {
        1: ("warcinfo", "ok", b"software: x\r\n", 13), 2: ("request", "ok", b"GET / HTTP/1.1\r\n\r\n", 18), 3: ("response", "ok", b"<p>one", 6), 4: ("response", "ok", b"two", 3),
        5: ("metadata", "ok", b"k: v", 4)}


def test_headers_of_any_form(spark, tmp_path):
    chunks = b"HTTP/1.1 200 OK\r\nTRANSFER-ENCODING:Chunked\r\nOdd line\r\n\r\n3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\nAnother: y\r\n\r\n"
    digest = b"sha1:" + hashlib.sha1(b"abc").hexdigest().encode()
    lower = [(b"page-id", b"1"), (b"content-TYPE", b"application/http"), (b"warc-payload-digest", digest), (b"X-Long", b"a\r\n  folded"), (b"Bad\xff", b"\xfe")]
    out = record(b"response", chunks, *lower, sep=b":")
    out += record(b"response", b"HTTP/1.0 200\n\nbare lines", page(2), HTTP, nl=b"\n")
    out += record(b"response", b"not http at all", page(3), (b"Content-Type", b"text/plain"), (b"WARC-Payload-Digest", b"blake3:zzz"))
    out += record(b"response", b"HTTP/1.1 200 OK\r\n\r\nabc", page(4), HTTP, (b"WARC-Payload-Digest", b"sha1:AAAA"))
    (tmp_path / "a.gz").write_bytes(gzip.compress(out))
    assert read(spark, tmp_path) == {1: ("response", "ok", b"abc", 3), 2: ("response", "ok", b"bare lines", 10), 3: ("response", "ok", b"not http at all", 15), 4: ("response", "digest differs", b"abc", 3)}


def test_broken_records_have_rows(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\npayload"
    lost = b"WARC/1.0\r\nWARC-Type: response\r\nPage-Id: 1\r\n\r\n" + block + b"\r\n\r\n"
    odd = record(b"response", block, page(2), HTTP, length=0).replace(b"Content-Length: 0", b"Content-Length: many")
    rest = record(b"response", block, page(3), HTTP) + record(b"response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", page(4), HTTP) + record(b"response", block, page(5), HTTP, length=9999)
    (tmp_path / "a.gz").write_bytes(gzip.compress(lost + odd + rest))
    assert read(spark, tmp_path) == {
        1: ("response", "length missing", None, None), 2: ("response", "length missing", None, None), 3: ("response", "ok", b"payload", 7), 4: ("response", "framing broken", None, None),
        5: ("response", "truncated", None, None)}


def test_broken_files(spark, tmp_path):
    whole = gzip.compress(record(b"response", b"HTTP/1.1 200 OK\r\n\r\nx", page(1), HTTP))
    (tmp_path / "cut.gz").write_bytes(whole + gzip.compress(record(b"response", bytes(range(256)) * 40, page(2)))[:200])
    (tmp_path / "noise.gz").write_bytes(b"no gzip, no record")
    (tmp_path / "empty.gz").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.status for r in rows) == ["compression broken", "no record", "ok", "truncated"]


def test_segments_without_an_origin_stay_rows(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(record(b"continuation", b"tail", (b"WARC-Segment-Number", b"2"), (b"WARC-Segment-Origin-ID", b"<urn:gone>"), page(7))))
    assert [r.status for r in warc.read_archives(spark, str(tmp_path)).collect()] == ["segments incomplete"]
