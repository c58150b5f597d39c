"""WARC archives: writing with identical-payload revisits and record segmentation, and reading with segment reassembly.

Writing. Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the largest id is a ``response``, and
the others are ``revisit`` records that refer to it by its address and date, and by its id in a header of our own. A response is an HTTP message in chunked transfer framing. A block
beyond ``SEGMENT_BYTES`` (small, so that pages of some kilobytes are split too) is split: its first segment is the response with segment number 1, the rest are ``continuation``
records that name its id, and the last of them the total length. The archives are WARC/1.1 files, gzipped whole:
each record is a row that Spark's text writer writes as it is (the line end that the writer adds is the record's last
byte), so any store that Spark can write holds them.

Reading. Files come through Spark's ``binaryFile`` reader and are unpacked and parsed piece by piece. Records meet their continuations, which
may stand in any file, in a shuffle by the origin's id, sorted by segment number; they are checked for gaps and against
the total length, and joined, one record at a time. The HTTP head is split off, the chunked framing decoded, and the
payload's digest verified.

Defined results: null html is an empty payload; rows with the same id and payload are alike (all responses, or all
revisits), each with a record of its own; a null id is written as an empty target, is never referred to, and is always a response; a missing, repeated
or surplus segment, a wrong length or a wrong digest raises an error that names the record; an empty table gives
archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, textbuf
from lethewise.operators.joins import lookup

REVISIT_BYTES = 1000
SEGMENT_BYTES = 1 << 10
#: Bytes of a chunk of the HTTP body.
CHUNK_BYTES = 2 << 10
#: Records in a file, about 200 MB before compression with SEGMENT_BYTES: what one row of the reader holds, compressed. A task that has
#: less to write makes a smaller file.
FILE_RECORDS = 1 << 17
#: Bytes of a file that are unpacked at once, and of blocks that are passed on together.
UNPACKED = 1 << 20

_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- one record -------------------------------------------------------------------------------------------------------

def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    """The body in chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = data[end + 2 : end + 2 + size]
        at = end + 2 + size
        if len(part) != size or data[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at += 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return dechunked(body)
    return body[: int(fields[b"content-length"])] if b"content-length" in fields else body


def headers(head: bytes) -> dict[str, str]:
    """The fields of a record's head, with lower-case names."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, piece by piece: as they are, or out of one or many gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(wbits=31)
        piece = member.decompress(data, UNPACKED)
        while piece or member.unconsumed_tail:
            yield piece
            piece = member.decompress(member.unconsumed_tail, UNPACKED)
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data


def parse(pieces: bytes | Iterable[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Records of a file, whole or in pieces: their heads, as they are and as fields, and their blocks. No more is held than
    a record and a piece."""
    data, at, before, more = b"", 0, 0, iter([pieces] if isinstance(pieces, bytes) else pieces)

    def have(n: int) -> bool:
        """Whether n bytes are there from ``at`` on, if need be with the next pieces."""
        nonlocal data, at, before
        held, size = [data[at:]], len(data) - at
        if size >= n:
            return True
        while size < n and (piece := next(more, None)) is not None:
            held.append(piece)
            size += len(piece)
        before, data, at = before + at, b"".join(held), 0
        return size >= n

    while have(1):
        have(8)
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {before + at}")
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not have(len(data) - at + 1):
                raise ValueError(f"the head at byte {before + at} has no end")
        raw = data[at:end]
        head = headers(raw)
        size, start = int(head["content-length"]), end + 4 - at
        if not have(start + size + 4) or data[at + start + size : at + start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} doesn't end where its length says")
        yield raw, head, data[at + start : at + start + size]
        at += start + size + 4


def _sha1(hexes: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexes)).decode()


def _page_records(place: str, page_id, url, payload: bytes, digest: str, refers_to, refers_url, segment_bytes: int) -> Iterator[bytes]:
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}:{page_id}:{digest}:{url}')}>"
    base = [
        ("WARC-Record-ID", rid), ("WARC-Date", _DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", _sha1(digest)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *base, kind, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", " ".join((refers_url or "").split())), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page", str(refers_to))], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), *base, kind], block)
        return
    for number, i in enumerate(range(0, len(block), segment_bytes), 1):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i + segment_bytes >= len(block) else []
        part = block[i : i + segment_bytes]
        if number == 1:
            yield record([("WARC-Type", "response"), *base, kind, ("WARC-Segment-Number", "1")], part)
        else:
            own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}:{number}')}>"
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(number)), *last], part)


# -- tables -----------------------------------------------------------------------------------------------------------

def revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = REVISIT_BYTES, url: str = "url") -> DataFrame:
    """Distinct (page_id, digest) of the pages that revisit another: refers_to is the largest id with that payload, refers_url
    its address (of several rows with that id, the last in order)."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    narrow = pages.select(F.col(page_id).alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes"), F.col(url).alias("url")).where(F.col("bytes") >= least)
    narrow = storage.written(narrow.where("page_id is not null"), "digests")
    first = storage.written(narrow.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "n", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url")), "first")
    return lookup(narrow, first, "digest", "n", narrow.count()).where("page_id < refers_to").select("page_id", "digest", "refers_to", "refers_url").distinct()


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write one record for each row of ``pages``, with its continuations, as WARC files under ``path``."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    # a written table, whose size is known: Spark broadcasts it where it is small enough, so that pages stay where they are
    seen = storage.written(revisits(pages, page_id, html, url=url).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to", "refers_url"), "revisits")
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(seen, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to", "refers_url")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a record's id holds its place in the writing task, so that rows which are alike are records of their own
        task, count = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            for some in textbuf.passes(batch, "payload"):
                out = [r[:-1] for x in some.to_pylist() for r in _page_records(f"{path}:{task}:{next(count)}", x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"], x["refers_url"], segment_bytes)]
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    rows.mapInArrow(build, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", file_records).text(path)


PAYLOADS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, n_segments int, payload binary"


def _decoded(head: dict[str, str], block: bytes, n_segments: int) -> dict:
    name, kind = head["warc-record-id"], head["warc-type"]
    claimed = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    page = int(head["x-page-id"]) if head.get("x-page-id") else None
    out = {"page_id": page, "url": head["warc-target-uri"], "record_type": kind, "payload_digest": claimed, "refers_to": None, "n_segments": n_segments, "payload": None}
    if kind == "revisit":
        fields = dict(x.split(b": ", 1) for x in block.split(b"\r\n\r\n")[0].split(b"\r\n")[1:])
        return out | {"refers_to": int(head["x-refers-to-page"]), "payload_bytes": int(fields[b"Content-Length"])}
    payload = http_payload(block)
    if hashlib.sha1(payload).hexdigest() != claimed:
        raise ValueError(f"record {name}: the payload's digest isn't the one it states")
    return out | {"payload": payload, "payload_bytes": len(payload)}


def joined(origin: str, segments: list[tuple[int, bytes, str | None]]) -> bytes:
    """The block of a segmented record from (number, part, total length or None)."""
    segments = sorted(segments, key=lambda s: s[0])
    if [n for n, _, _ in segments] != list(range(1, len(segments) + 1)):
        raise ValueError(f"record {origin}: segments {[n for n, _, _ in segments]}")
    block, total = b"".join(p for _, p, _ in segments), segments[-1][2]
    if total is None or int(total) != len(block):
        raise ValueError(f"record {origin}: {len(block)} bytes of {total}")
    return block


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of the archives under ``path``: columns PAYLOADS."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.string()), ("head", pa.binary()), ("block", pa.binary())])

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

        for batch in batches:
            for data in batch.column("content"):
                out, size = [], 0
                for raw, head, block in parse(unpacked(data.as_py())):
                    number = int(head.get("warc-segment-number", 0))
                    origin = head.get("warc-segment-origin-id") or head["warc-record-id"]
                    out.append((origin, number, head.get("warc-segment-total-length"), raw if number < 2 else None, block))
                    size += len(block)
                    if size > UNPACKED:
                        yield table(out)
                        out, size = [], 0
                yield table(out)
            textbuf.give_back()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("n_segments", pa.int32()), ("payload", pa.binary())])
        now, parts, first, out, size = None, [], None, [], 0

        def done() -> int:
            """Pass the record on; its payload's bytes."""
            if first is None:
                raise ValueError(f"record {now}: its first segment is missing")
            out.append(_decoded(headers(first), joined(now, parts) if parts else block, max(1, len(parts))))
            return len(out[-1]["payload"] or b"")

        for batch in batches:
            for origin, number, total, head, part in zip(*(batch.column(c).to_pylist() for c in ("origin", "number", "total", "head", "block")), strict=True):
                if now is not None and origin != now:
                    size += done()
                    now, parts, first = None, [], None
                if size > textbuf.PASS_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
                now, first = origin, head if number < 2 else first
                if number:
                    parts.append((number, part, total))
                else:
                    block = part
        if now is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.mapInArrow(split, "origin string, number int, total string, head binary, block binary").repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(assemble, PAYLOADS)
