"""WARC archives: records written with segments and chunked framing, and read back by reassembling the segments."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import as_bytes, land, small_batches

#: Largest block of a record; a longer one goes on in continuation records.
SEGMENT_BYTES = 32 << 10
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 4096
#: Records of an archive file at most, so a file holds at most SEGMENT_BYTES times as many bytes and some headers.
RECORDS_PER_FILE = 1024
BATCH_BYTES = 4 << 20
#: What ends a record.
END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(piece), piece) for i in range(0, len(payload), CHUNK_BYTES) if (piece := payload[i : i + CHUNK_BYTES])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, whatever extensions and trailer fields it has; None if the framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        at = end + 2
        if size < 0:
            return None
        if not size:
            # Trailer fields, if any, then an empty line.
            return b"".join(out) if body[at : at + 2] == b"\r\n" or body.find(END, at) >= 0 else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without its end; headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in (*headers, ("Content-Length", len(block))) if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def _records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, seed: str) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response in as many segments as its block needs."""
    urn = lambda n: f"<urn:md5:{hashlib.md5(f'{seed}:{n}'.encode()).hexdigest()}>"
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url is not None else None
    common = [("WARC-Target-URI", target), ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", urn(1)), ("WARC-Profile", profile), ("Refers-To-Page-Id", refers_to), *common], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    number = (lambda n: n) if len(pieces) > 1 else (lambda n: None)
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", urn(1)), ("WARC-Segment-Number", number(1)), *common], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(n)), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", urn(1)), ("WARC-Segment-Total-Length", total)], piece)


def write_archives(pages: DataFrame, path: str, dedup_from_bytes: int = 0) -> None:
    """Write a record per page (page_id, url, html) to gzip archives below `path`.

    Of pages with equal html of at least `dedup_from_bytes` bytes, those with the largest page_id are responses and the others revisit
    it; a null page_id counts as the smallest, and a null html as empty. Payloads move once, to meet the largest page_id of
    their digest; that is folded on the map side, so a payload with very many copies is one row there. An empty table writes no record.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    # Landed, so that the join with a payload of very many copies can be split.
    newest = land(rows.where(F.octet_length("html") >= dedup_from_bytes).groupBy("_sha").agg(F.max("page_id").alias("_newest")), "newest-payloads")
    revisit = F.col("_newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_newest"))
    told = rows.join(newest, "_sha", "left").select("page_id", "url", "html", F.when(revisit, F.col("_newest")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        for batch in small_batches(batches, BATCH_BYTES, "html"):
            out = []
            for page_id, url, payload, refers_to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), as_bytes(batch.column("html")), batch.column("refers_to").to_pylist()):
                n += 1
                out += _records(page_id, url, payload, refers_to, f"{page_id}:{context.partitionId()}:{n}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    written = told.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    # The text sink adds the end of each record and commits whole files only.
    written.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _members(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """What each gzip member of a file holds, or the file itself if it isn't compressed, and whether it is whole."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data, True
        return
    while data:
        inflater = zlib.decompressobj(31)
        try:
            out = inflater.decompress(data) + inflater.flush()
        except zlib.error:
            yield b"", False
            return
        yield out, inflater.eof
        # Padding between members is no member.
        data = inflater.unused_data.lstrip(b"\0")


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the field before them, lines without a colon to none."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


_HEAD_END = re.compile(rb"\r?\n\r?\n")
_NEXT = re.compile(rb"(?:\r?\n)+(?=WARC/\d)")


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """Headers, block and state of each record of an archive file, also of a broken one; after a record without a length it goes on at the next start of one."""
    for member, whole in _members(data):
        at = len(member) - len(member.lstrip(b"\r\n"))
        while at < len(member):
            end = _HEAD_END.search(member, at)
            headers = _fields(member[at : end.start()]) if end and member.startswith(b"WARC/", at) else {}
            size = headers.get("content-length", "")
            if not size.isdecimal():
                following = _NEXT.search(member, at)
                stop = following.end() if following else len(member)
                yield headers, b"", "no record" if not headers else "length missing"
                at = stop
                continue
            start = end.end()
            at = start + int(size)
            yield headers, member[start:at], "ok" if at <= len(member) else "truncated"
            while member[at : at + 1] in (b"\r", b"\n"):
                at += 1
        if not whole:
            yield {}, b"", "compression broken"


_DIGESTS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


def _fits(stated: str | None, payload: bytes) -> bool:
    """Whether a payload has the digest that is stated, in base 32 or hex; a digest of another kind is not judged."""
    kind, _, value = (stated or "").rpartition(":")
    made = _DIGESTS.get(kind.lower().replace("-", "") or "sha1")
    if not value or made is None:
        return True
    digest = made(payload).digest()
    return value.upper().rstrip("=") in (base64.b32encode(digest).decode().rstrip("="), digest.hex().upper())


def _payload(headers: dict, block: bytes | None) -> tuple[bytes | None, int | None, str]:
    """Payload, its length and the state of a whole block; of other than HTTP records the block is the payload."""
    if block is None:
        return None, None, "segments incomplete"
    http = "application/http" in (headers["content"] or "") and headers["type"] in ("response", "revisit")
    head, body, fields = b"", block, {}
    if http:
        cut = _HEAD_END.search(block)
        head, body = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
        fields = _fields(head)
    if headers["type"] == "revisit":
        length = fields.get("content-length", "")
        return None, int(length) if length.isdecimal() else None, "ok"
    payload = unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body
    if payload is None:
        return None, None, "framing broken"
    state = "ok" if _fits(headers["stated"], payload) else "digest differs"
    return payload, len(payload), state


_OUT = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, status string, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in _OUT.split(", ")])


def _number(value: str | None) -> int | None:
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


def _facts(h: dict[str, str]) -> dict:
    digest = h.get("warc-payload-digest")
    return {
        "page_id": _number(h.get("page-id")), "type": h.get("warc-type", "").lower() or None, "refers_to": _number(h.get("refers-to-page-id")),
        "digest": digest and digest.rpartition(":")[2], "stated": digest, "content": h.get("content-type"),
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`: page_id, record_type, refers_to, payload_digest, payload_bytes, status, payload.

    Archives are files *.gz, of one gzip member for each record or for all, or *.warc. A record in one piece is decoded where its file is read. Segments
    are grouped by their origin, ordered by number, and joined if the numbers have no gap and their lengths add up to the stated total; then the
    chunked framing is decoded and the digest compared. Records of every type have a row, of all but HTTP messages with the block as payload. Header names are
    read in any case, with or without a space after the colon. status says what failed (else ok): truncated, length missing, no record, compression broken,
    segments incomplete, framing broken, digest differs. A failed record keeps its row without a payload, and the records after it are read.
    Revisits have no payload, but its length and digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")

    def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[dict[str, str], bytes, str]]]:
        for batch in batches:
            for content in batch.column("content"):
                yield _parsed(content.as_py() or b"")

    def in_segments(h: dict[str, str], state: str) -> bool:
        return state == "ok" and _number(h.get("warc-segment-number")) is not None and "warc-record-id" in h

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in files_of(batches):
            rows, held = [], 0
            for h, block, state in records:
                if not in_segments(h, state):
                    f = _facts(h)
                    payload, size, state = _payload(f, block) if state == "ok" else (None, None, state)
                    rows.append((f["page_id"], f["type"], f["refers_to"], f["digest"], size, state, payload))
                    held += size or 0
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in files_of(batches):
            rows = []
            for h, block, state in records:
                if in_segments(h, state):
                    f = _facts(h)
                    number = _number(h["warc-segment-number"])
                    first = number == 1
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), number, _number(h.get("warc-segment-total-length")), f["page_id"], f["type"] if first else None, f["stated"], f["content"] if first else None, block))
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["origin", "n", "total", "page_id", "type", "stated", "content", "block"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                numbers, block = [p["n"] for p in r["parts"]], b"".join(p["block"] for p in r["parts"])
                complete = numbers == list(range(1, len(numbers) + 1)) and r["total"] == len(block)
                payload, size, state = _payload(r, block if complete else None)
                yield _batch([(r["page_id"], r["type"], None, r["stated"] and r["stated"].rpartition(":")[2], size, state, payload)])

    parts = files.mapInArrow(segments, "origin string, n int, total long, page_id long, type string, stated string, content string, block binary")
    origins = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("n", "block"))).alias("parts"),
        *[F.max(c).alias(c) for c in ("total", "page_id", "type", "stated", "content")],
    )
    return files.mapInArrow(whole, _OUT).unionByName(origins.drop("origin").mapInArrow(joined, _OUT))
