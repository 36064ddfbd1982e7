"""WARC archives: writing pages with revisits for equal payloads, and a reader that salvages damaged archives.

Every record is a gzip member of its own. Spark's text writer puts blocks of members into files, with an empty member as the
line separator, so that a lost task leaves nothing behind and any store that Spark writes to will do.

The reader takes records one after another, compressed or not. Each must pass its checks: the member's checksum, the version
line, the lengths, the digests. Where one fails, it looks for the next member or version line whose record passes, goes on
from there, and returns the bytes between as a quarantined gap with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import text_chunks, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
BLOCK_BYTES = 4 << 20  # of records in one value of the writer
BLOCKS = 16  # of a file
STEP = 1 << 16
ARCHIVE = re.compile(rb"WARC/1\.\d\r\n")
NEXT = re.compile(re.escape(MAGIC) + rb"|WARC/1\.\d\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member that is the same for the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- writing --------------------------------------------------------------------------------------------------------


def record_id(page_id) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str | None, payload: bytes, first, revisit: bool, date: str) -> bytes:
    """One record: the page as an HTTP response, or its head only where it revisits the page ``first``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": date,
        # A line break or a blank would end the field or the address.
        "WARC-Target-URI": re.sub(r"\s", lambda m: quote(m[0]), url) if url else None, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first)}
    fields["Content-Length"] = len(block)
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def roles(pages: DataFrame, least: int, key: str, html: str) -> DataFrame:
    """key, url, text, first, revisit: every page with the smallest key of the pages with its payload, and whether it revisits that.

    Only payloads that more than one page has are joined back, so a payload that a large part of all pages share is one row.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col(key).alias("key"), url.cast("string").alias("url"), payload.alias("text"))
    sized = rows.select("key", F.sha1("text").alias("sha"), F.octet_length("text").alias("bytes")).filter(F.col("bytes") >= least)
    shared = sized.groupBy("sha", "bytes").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = written(shared.select("sha", "bytes", "first", F.lit(True).alias("shared")), "warc-shared")
    joined = rows.join(shared, (F.sha1("text") == F.col("sha")) & (F.octet_length("text") == F.col("bytes")), "left")
    revisit = F.coalesce(F.col("shared") & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("key", "url", "text", "first", revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, least: int = 0, key: str = "page_id", html: str = "html") -> None:
    """Archives of all rows of ``pages`` in the new folder ``path``, one record a row.

    Of equal payloads of at least ``least`` bytes, the row with the smallest key is a response and the others revisit it; all smaller
    payloads are responses. A null page is an empty payload. A null key is larger than any other; rows that share the
    smallest key and the payload are responses each. ``url`` is written where there is one; other columns are ignored.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_chunks(batches, BLOCK_BYTES):
            keys, urls, firsts, revisits = (batch.column(c).to_pylist() for c in ("key", "url", "first", "revisit"))
            payloads = (value.as_buffer().to_pybytes() if len(value.as_buffer() or b"") else b"" for value in text.cast(pa.large_binary()))
            members = [member(record(k, u, p, f, r, date)) for k, u, p, f, r in zip(keys, urls, payloads, firsts, revisits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.large_binary())], ["value"])

    blocks = roles(pages, least, key, html).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # The separator is itself a member, an empty one, in an encoding that maps each character to one byte.
    separated = blocks.write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1"))
    separated.option("maxRecordsPerFile", BLOCKS).text(path)


# --- reading --------------------------------------------------------------------------------------------------------


class Record(NamedTuple):
    """What an archive says of a record, its place in the file, and its payload."""

    offset: int
    length: int
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int


class Damaged(Exception):
    """Why a record cannot be taken; ``end`` is where it stops, if that is certain."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def fields_of(lines: bytes) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins with a blank goes on the field before."""
    found: dict[str, str] = {}
    name = ""
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parsed(data: bytes | memoryview, start: int) -> tuple[dict[str, str], bytes, int, int]:
    """Fields, payload, payload bytes and end of the record that begins at ``start`` of plain bytes."""
    head = data.find(b"\r\n\r\n", start)
    if not ARCHIVE.match(data, start) or head < 0:
        raise Damaged("no version line or no end of the fields")
    fields = fields_of(data[data.find(b"\r\n", start) + 2 : head])
    if not fields.get("content-length", "").isdecimal():
        raise Damaged("no content length")
    stop = head + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    block = data[head + 4 : stop]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else b""
        told = fields_of(block[:cut]).get("content-length", "") if cut >= 0 else ""
        size = int(told) if fields.get("warc-type") == "revisit" and told.isdecimal() else len(payload)
    checks = [("warc-block-digest", block)] + ([("warc-payload-digest", payload)] if fields.get("warc-type") != "revisit" else [])
    for name, part in checks:
        if fields.get(name, "").startswith("sha1:") and fields[name][5:] != digest(part):
            raise Damaged(f"{name} differs", stop + 4)
    return fields, payload, size, stop + 4


def unpacked(data: bytes, start: int) -> tuple[bytes, int]:
    """The bytes of the gzip member that begins at ``start``, its checksum and length tested, and its end."""
    reader, parts, at = zlib.decompressobj(31), [], start
    try:
        while not reader.eof:
            if at >= len(data):
                raise Damaged("the member is cut off")
            parts.append(reader.decompress(data[at : at + STEP]))
            at = min(at + STEP, len(data))
    except zlib.error as error:
        raise Damaged(f"the member is damaged: {error}") from None
    return b"".join(parts), at - len(reader.unused_data)


def records_at(data: bytes, start: int) -> tuple[list[Record], int]:
    """The records of the member, or the plain record, that begins at ``start``, and its end; an empty member has none."""
    if data.startswith(MAGIC, start):
        plain, end = unpacked(data, start)
        found, at = [], 0
        while at < len(plain):
            try:
                fields, payload, size, at = parsed(plain, at)
            except Damaged as error:
                raise Damaged(error.reason, end) from None
            found.append(Record(start, end - start, fields, payload, size))
        return found, end
    fields, payload, size, end = parsed(data, start)
    return [Record(start, end - start, fields, payload, size)], end


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """All records of an archive in order, and a (start, end, reason) for every stretch that belongs to none."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            found, end = records_at(data, at)
        except Damaged as error:
            if bad is None:
                bad, reason = at, error.reason
            # A record of certain extent that fails a digest is passed over whole; otherwise the next beginning may lie inside.
            near = NEXT.search(data, error.end if error.end else at + 1)
            at = near.start() if near else len(data)
            if error.end and near and at == error.end:
                yield bad, at, reason
                bad = None
            continue
        if bad is not None:
            yield bad, at, reason
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield bad, len(data), reason


READ = "path string, offset long, length long, gap string, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for every record and for every gap in the archives below ``path``.

    path, offset, length: where it is; gap: why these bytes were passed over, null for a record. Then the record's type, id, address,
    date, id that it refers to, payload digest without its ``sha1:``, bytes of the full payload (for a revisit those that its
    HTTP head states) and payload (null for gaps, and for all if not asked for). A file is read as one value, which Spark limits to 2 GB.
    """

    def row(found: Record | tuple[int, int, str], name: str) -> tuple:
        if not isinstance(found, Record):
            start, end, reason = found
            return (name, start, end - start, reason, *[None] * 8)
        field = found.fields.get
        named = [field(f"warc-{x}") for x in ("type", "record-id", "target-uri", "date", "refers-to")]
        known = re.sub("^sha1:", "", field("warc-payload-digest") or "") or digest(found.payload)
        return (name, found.offset, found.length, None, *named, known, found.payload_bytes, found.payload if payloads else None)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]
    names = [column.split()[0] for column in READ.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, content in zip(files.column("path").to_pylist(), files.column("content"), strict=True):
                rows, held = [], 0
                for found in salvage(content.as_py()):
                    rows.append(row(found, name))
                    held += len(found.payload) if payloads and isinstance(found, Record) else 200
                    if held > BLOCK_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, READ)


def log_gaps(read: DataFrame, path: str) -> None:
    """Writes the quarantined stretches of ``read_archives`` as JSON lines: path, offset, length, reason."""
    read.filter("gap is not null").select("path", "offset", "length", F.col("gap").alias("reason")).write.json(path)


def page_key(record_id: Column, kind: str) -> Column:
    """The key of the page that a record id of ``write_archives`` stands for."""
    return F.url_decode(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1)).cast(kind)


def pages_of(read: DataFrame, kind: str, key: str = "page_id") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of the records of ``read``."""
    at = lambda c: F.when(F.col(c).startswith("<urn:page:"), page_key(F.col(c), kind))
    return read.filter("gap is null").select(at("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", at("refers_to").alias("refers_to"))
