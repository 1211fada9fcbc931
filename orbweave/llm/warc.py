"""WARC archives: one gzip member a record, written by Spark's own writer; a reader that salvages what damage leaves.

Equal payloads are found from digests alone: html never travels for them. A task packs records into gzip members and
members into blocks of about BLOCK_BYTES; an archive holds at most ARCHIVE_BLOCKS of these, so its size is bounded by
bytes. Reading checks each record's version line, lengths, ends and digests. At every place it takes a gzip member or a
version line, whichever is there; a member may hold several records, and of a truncated or damaged member the part that
inflates is searched too. After a failed check the reader goes to the next place where a member or record may start, and
reports the bytes between as a quarantined gap; nothing is dropped without a row.

Defined cases: a null payload is an empty one; equal payloads, the empty one included, have one response (the smallest
page_id; repeated rows of that page_id are responses too), the others are revisits; a null page_id is written as a
response without identity and never referred to; other columns are ignored; an empty table gives no records; an archive
is read whole by one task, so archives from elsewhere must stay under 2 GB each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .textscan import give_back, slices, text_bytes
from .workspace import fresh_path, materialize

CRLF = "\r\n"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
#: Bytes of a block of gzip members, about; blocks of one archive at most; the level of compression.
BLOCK_BYTES, ARCHIVE_BLOCKS, LEVEL = 4 << 20, 16, 4
#: So many digests of several pages (some 60 bytes each) are broadcast at most.
BROADCAST_DIGESTS = 1 << 19
#: A gzip member is inflated by so many bytes at a time.
STEP = 1 << 16


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column: five hex digits are four base32 digits."""
    hexed = F.sha1(value)
    quads = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def warc_records(pages: DataFrame) -> DataFrame:
    """Per page: header and block (text) of its record, a response or a revisit of the first page with an equal payload."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    first = rows.select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last")
    first = materialize(first, "warc-repeats")
    # Only digests of several pages are needed: few go to the pages, many meet them in a shuffle.
    rows = rows.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, "digest", "left")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    block = F.when(revisit, head).otherwise(F.concat(head, "html"))
    header = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    lines = F.concat(
        F.lit("WARC/1.1" + CRLF),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.coalesce(urn("page_id"), F.lit("<urn:page:>"))),
        header("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        header("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(header("WARC-Refers-To", urn("first")), header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(lines.alias("header"), block.alias("block"))


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _packer(block_bytes: int) -> Callable:
    """Rows that Spark's text writer ends with a zero byte: the last byte of a gzip member of less than 16 MiB is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            whole = b"".join(held)
            held.clear()
            # A longer record's member is followed by the zero byte, which readers of gzip take as padding.
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1] if whole.endswith(b"\0") else whole], pa.binary())], names=["value"])

        for rows, blocks in slices(batches, 1):
            for header, block in zip(text_bytes(rows.column(0)), text_bytes(blocks), strict=True):
                digest = f"WARC-Block-Digest: sha1:{digest_of(block)}{CRLF}".encode()
                held.append(gzip_member(b"".join((header, digest, b"\r\n", block, b"\r\n\r\n"))))
                size += len(held[-1])
                if size >= block_bytes or not held[-1].endswith(b"\0"):
                    yield made()
                    size = 0
        if held:
            yield made()

    return run


def write_warc(pages: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> str:
    """Write pages(page_id, url, html) as archives into a new folder of shared storage; returns the folder."""
    path = path or fresh_path(pages.sparkSession, "warc")
    blocks = warc_records(pages).mapInArrow(_packer(block_bytes), "value binary").select(F.col("value").cast("string"))
    blocks.write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE_BLOCKS).text(path)
    return path


@dataclass
class Record:
    """A record or a gap. Records after the first of one gzip member have length 0; inner_offset tells them apart."""

    offset: int
    length: int
    status: str  # record or quarantine
    reason: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    inner_offset: int = 0


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """(record, its end, "") at a version line, or (None, at, what failed)."""
    version = next((v for v in VERSIONS if data.startswith(v, at)), None)
    if version is None:
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None, at, "no end of headers"
    headers = {}
    for line in data[at + len(version) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "a header without a colon"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        return None, at, "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "the block does not end where it should"
    block = data[start:stop]
    stated = headers.get("warc-block-digest", "")
    if stated.lower().startswith("sha1:") and stated[5:].upper() != digest_of(block):
        return None, at, "block digest differs"
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else b""
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", block[: cut + 2])
        headers["http-content-length"] = length[1].decode() if length else ""
    stated = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and stated.lower().startswith("sha1:") and stated[5:].upper() != digest_of(payload):
        return None, at, "payload digest differs"
    return Record(at, stop + 4 - at, "record", "", headers, payload), stop + 4, ""


def inflate_member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place and its end, or what inflates of a damaged one and -1."""
    d, view, out, place = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while place < len(data) and not d.eof:
            out.append(d.decompress(view[place : place + STEP]))
            place += STEP
    except zlib.error:
        pass
    end = min(place, len(data)) - len(d.unused_data) if d.eof else -1
    return b"".join(out), end


def _marks(data: bytes, at: int, marks: dict[bytes, int]) -> int:
    """The next place after `at` where one of the marks stands, or the end of the data."""
    for v in marks:
        if marks[v] <= at and marks[v] >= 0:
            marks[v] = data.find(v, at + 1)
    return min((m for m in marks.values() if m >= 0), default=len(data))


def salvage(data: bytes) -> Iterator[Record]:
    """Records and quarantined gaps of one archive, in order; together they are all its bytes."""
    at, gap, why = 0, None, ""
    marks = {v: data.find(v) for v in (b"\x1f\x8b\x08", *VERSIONS)}  # the next place of each, -1 if there is none
    while at < len(data):
        if data.startswith(b"\x1f\x8b", at):
            inner, end = inflate_member(data, at)
            found = list(salvage_plain(inner))
            records = [r for r in found if r.status == "record"]
            whole, reason = end >= 0 and bool(records), "no record in a gzip member"
            if whole:
                while data[end : end + 1] == b"\0":  # padding
                    end += 1
            elif end < 0:
                reason, found = "a gzip member fails", records
            for i, r in enumerate(found):
                r.inner_offset, r.offset, r.length = r.offset, at, end - at if whole and not i else 0
        else:
            record, end, reason = parse_record(data, at)
            found, whole = [record] if record else [], record is not None
        if gap is not None and (whole or found):
            yield Record(gap, at - gap, "quarantine", why)
            gap = None
        if not whole and gap is None:
            gap, why = at, reason
        yield from found
        at = end if whole else _marks(data, at, marks)
    if gap is not None:
        yield Record(gap, len(data) - gap, "quarantine", why)


def salvage_plain(data: bytes) -> Iterator[Record]:
    """Records and gaps of uncompressed data."""
    at, gap, why = 0, None, ""
    marks = {v: data.find(v) for v in VERSIONS}
    while at < len(data):
        record, end, reason = parse_record(data, at)
        if record:
            if gap is not None:
                yield Record(gap, at - gap, "quarantine", why)
                gap = None
            yield record
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        at = _marks(data, at, marks)
    if gap is not None:
        yield Record(gap, len(data) - gap, "quarantine", why)


READ = "archive string, offset long, length long, inner_offset long, status string, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long"


def _reader(payloads: bool) -> Callable:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in READ.split(", ")]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def rows(archive: str, content: bytes) -> Iterator[tuple]:
        for r in salvage(content):
            h = r.headers
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or (digest_of(r.payload) if r.status == "record" else None)
            size = len(r.payload)
            if h.get("warc-type") == "revisit":
                size = int(h.get("http-content-length") or 0)
            row = (archive, r.offset, r.length, r.inner_offset, r.status, r.reason, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size)
            yield (*row, r.payload) if payloads else row

    def batched(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in found:
            held.append(row)
            size += 200 + (len(row[-1]) if payloads else 0)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from batched(rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
        give_back()

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under a path. A revisit's payload_bytes is the length it states."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(_reader(payloads), READ + ", payload binary" * payloads)
