"""WARC archives: segmented, chunked records written and read back whole.

Writing: every page is a record whose block is an HTTP response in chunked transfer coding. Of records with equal
payloads of min_bytes or more, the one with the smallest id is the response, the others revisit it. A block longer than
segment_bytes is cut into segments: the first keeps the record's type, the others are continuations that name its
record as their origin and carry a segment number, the last one the total length. Records are text rows that Spark's
own writer ends by the format's two line ends, in compressed files of at most RECORDS_PER_FILE records.

Reading: files are parsed record by record; segments are grouped by origin, ordered by number, checked for gaps and for
the total length, and joined; then the chunked framing is decoded and the payload's digest is checked.

Groups are one record's segments, so no group is larger than a payload. Equal payloads meet as one row for each digest,
after a map-side minimum, and are joined back by a join that Spark can split.

Defined cases: null html is an empty payload, which counts as any other; a null id comes last in its group, and a group
of null ids only has no revisits; rows with equal ids and payloads are all responses if theirs is the smallest id;
a null url leaves its header out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import new_path

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 20_000
#: Parsed bytes that are handed on at once.
BATCH_BYTES = 8 << 20
EOL = b"\r\n"
PARSED = "record_id string, page_id long, type string, refers_to long, digest string, origin string, segment int, total long, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer coding."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; extensions and trailers are left out."""
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != EOL:
            raise ValueError("a chunk is shorter than its size says")
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, unique: int, segment_bytes: int) -> Iterator[bytes]:
    """A page's record, or its first segment and the continuations."""
    name = f"<urn:larkspur:record:{unique}>"
    digest = "sha1:" + base32_sha1(payload)
    own = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id),
    ]
    if refers_to is not None:  # the block is the header of the response that isn't stored again
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", "2024-01-01T00:00:00Z"), ("X-Refers-To-Page-ID", refers_to)]
        yield _record(own, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(own, block)
        return
    segments = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*own, ("WARC-Segment-Number", 1)], segments[0])
    for n, segment in enumerate(segments[1:], 2):
        total = len(block) if n == len(segments) else None
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:larkspur:record:{unique}:{n}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
             ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], segment,
        )


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes an archive of pages to path."""
    rows = pages.select(pages[key].cast("long").alias("key"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("binary"), F.lit(b"")).alias("payload"))
    same = F.sha2("payload", 256)
    copies = rows.where(F.octet_length("payload") >= min_bytes).select("key", "url", same.alias("same")).groupBy("same").agg(F.min("key").alias("first"), F.min(F.struct(F.col("key").isNull(), "key", "url"))["url"].alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first")))
    long_enough = F.when(F.octet_length("payload") >= min_bytes, same)
    told = rows.withColumn("same", long_enough).join(copies, "same", "left").select("key", "url", "payload", F.when(revisits, F.col("first")).alias("first"), F.when(revisits, F.col("first_url")).alias("first_url"))

    def made(batches):
        unique = TaskContext.get().partitionId() << 33
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "first", "first_url")), strict=True):
                for record in records_of(*row, unique, segment_bytes):
                    out.append(record)
                    size += len(record)
                unique += 1
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    records = told.mapInArrow(made, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def unzipped(content: bytes) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of a plain one, bit by bit."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        unzip = zlib.decompressobj(31)
        while content and not unzip.eof:
            yield unzip.decompress(content, 1 << 20)
            content = unzip.unconsumed_tail
            if not content and not unzip.eof:
                yield unzip.flush()
                break
        content = unzip.unused_data


def records_in(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file."""
    buffer, source = bytearray(), unzipped(content)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            more = next(source, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while fill(1) and buffer[:1] in (b"\r", b"\n"):
            del buffer[: len(buffer) - len(buffer.lstrip(b"\r\n"))]
        if not fill(1):
            return
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("a record's header has no end")
        lines = bytes(buffer[:end]).decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("a record's block is shorter than its length says")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]
        yield headers, block


def parsed(files: DataFrame) -> DataFrame:
    """The records of archive files (content binary), one row each, segments apart."""
    number = lambda x: None if x is None else int(x.strip("<>").rpartition(":")[2])
    names = [f.split()[0] for f in PARSED.split(", ")]

    def parse(batches):
        out, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for h, block in records_in(content.as_py()):
                    segment = h.get("warc-segment-number")
                    origin = h.get("warc-segment-origin-id") or (h["warc-record-id"] if segment else None)
                    out.append((
                        h["warc-record-id"], number(h.get("x-page-id")), h["warc-type"], number(h.get("x-refers-to-page-id")), h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        origin, segment and int(segment), number(h.get("warc-segment-total-length")), block,
                    ))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return files.select("content").mapInArrow(parse, PARSED)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with their segments joined, and whole: no segment is missing and the total length is right."""
    alone = records.where("origin IS NULL").select("record_id", "page_id", "type", "refers_to", "digest", F.lit(True).alias("whole"), "block")
    groups = records.where("origin IS NOT NULL").groupBy("origin").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "type", "refers_to", "digest")], F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
    )
    joined = groups.withColumn("block", F.aggregate("segments", F.lit(b""), lambda a, s: F.concat(a, s["block"])))
    in_order = F.transform("segments", lambda s: s["segment"]) == F.sequence(F.lit(1), F.size("segments"))
    whole = F.coalesce(in_order & (F.octet_length("block") == F.col("total")), F.lit(False))
    return alone.unionByName(joined.select(F.col("origin").alias("record_id"), "page_id", "type", "refers_to", "digest", whole.alias("whole"), "block"))


def payloads(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Per record: payload_bytes, payload_digest and, unless it is a revisit, the payload itself; nulls if it isn't whole.

    A revisit has its size from the header of the response that wasn't stored again, and its digest from its record.
    """

    def decode(batches):
        for batch in batches:
            rows = []
            for kind, told, whole, block in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "whole", "block")), strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(EOL)[1:])}
                if not whole:
                    rows.append((None, None, None))
                elif kind == "revisit":
                    rows.append((int(fields[b"content-length"]), told, None))
                else:
                    payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                    found = base32_sha1(payload)
                    if told and found != told:
                        raise ValueError(f"the payload's digest is {found}, the record says {told}")
                    rows.append((len(payload), found, payload))
            size, digest, payload = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column("page_id"), batch.column("type"), batch.column("refers_to"), pa.array(size, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(payload, pa.binary())] * keep_payload, names=names)

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * keep_payload
    names = [f.split()[0] for f in schema.split(", ")]
    return records.mapInArrow(decode, schema)


def read(spark, path: str, **options) -> DataFrame:
    return payloads(reassembled(parsed(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))), **options)


def digests(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes an archive of pages and returns what is read from it."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
