"""WARC archives: a writer with revisit records for equal payloads, and a reader that salvages damaged files.

Writer. Payloads are grouped by SHA-1 and length on narrow rows; the largest page_id of a group becomes its response, the
others revisit it. Rows are dealt to tasks by a hash of the page, and each task writes archives of about ARCHIVE_BYTES to a
shared folder, one gzip member for each record; a file appears under its final name only when it is whole.

Reader. A file is read once, front to back, in a window that holds one record. A gzip member must decompress with its check
sum and hold one record; a record needs a version line, a length and the blank lines after its block; its block digest must
agree. After a failed check the reader looks for the next place at which a member or a version line starts and passes
the checks, and goes on from there; what lies between comes out as a gap with its offset, length and the check that failed.
Files with records as plain text are read alike.

Defined cases: a null html is an empty payload; control characters of a url are written percent-encoded, and a url may be as
long as a record; equal payloads of any length are one group; rows that share the largest
page_id of their group, repeated rows too, are each a response; a null page_id is never referred to unless all of its group
are null, and then its rows are responses; other columns are ignored; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import shared_dir, sliced, texts, written

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 17
#: A record that claims more than this is taken as damaged: beyond the longest string that a row can hold.
MOST_RECORD = (1 << 31) + (1 << 20)
CONTROL = re.compile(r"[\x00-\x1f\x7f]")
VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
FILES = "path string, n_records long, n_bytes long"
RECORDS = "path string, offset long, length long, kind string, reason string, page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    """The page_id in a record's name, if it has one."""
    body = (name or "").strip("<>").rpartition(":")[2]
    return int(body) if body.lstrip("-").isdigit() else None


def escaped(uri: str) -> str:
    """The URI with control characters percent-encoded: a line break would end its header."""
    return CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", uri)


def record(page_id: int | None, uri: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit whose HTTP header tells the payload's length."""
    digest = sha1_base32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {escaped(uri)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, always the same bytes for the same data."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    """A check that failed."""


class NeedsMore(Exception):
    """The window ends before the record does."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def parsed(data: bytes, at: int, final: bool) -> tuple[Record, int]:
    """The plain record at a place of data and its length. final: no more data will come."""

    def short(what):
        return Damaged(what) if final else NeedsMore()

    start = bytes(data[at : at + 7])
    if start != b"WARC/1.":
        raise short("version line") if b"WARC/1.".startswith(start) else Damaged("version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("headers") if len(data) - at >= MOST_RECORD else short("headers")
    headers = {}
    for line in bytes(data[at:head]).decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise Damaged("headers")
        headers[key.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or int(size) > MOST_RECORD:
        raise Damaged("length")
    end = head + 4 + int(size)
    if len(data) < end + 4:
        raise short("truncated")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = bytes(data[head + 4 : end])
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise Damaged("block digest")
    return Record(headers, block), end + 4 - at


def unpacked(data: bytes, at: int, final: bool) -> tuple[Record, int]:
    """The record in the gzip member at a place of data and the member's length. Only the member itself is looked at."""
    opener, plain, feed = zlib.decompressobj(31), bytearray(), at
    while feed < len(data) and not opener.eof:
        try:
            plain += opener.decompress(data[feed : feed + READ_BYTES])
        except zlib.error as e:
            raise Damaged(f"gzip: {str(e)[:60]}") from None
        if len(plain) > 2 * MOST_RECORD:
            raise Damaged("length")
        feed += READ_BYTES
    if not opener.eof:
        raise Damaged("truncated") if final else NeedsMore()
    found, size = parsed(plain, 0, True)
    if size != len(plain):
        raise Damaged("member holds more than a record")
    return found, min(feed, len(data)) - len(opener.unused_data) - at


def salvaged(read) -> Iterator[tuple[int, int, Record | None, str | None]]:
    """offset, length and a record, or a gap's reason, over a whole file. read(n) gives the next bytes, none at the end.

    The window is cut only where most of it is behind, so a false length that made it long costs no copy for each candidate."""
    window, at, base, final = bytearray(), 0, 0, False  # base: the offset of the window's first byte
    gap, reason, want = None, None, READ_BYTES
    while True:
        while len(window) - at < want and not final:
            more = read(max(READ_BYTES, want - (len(window) - at)))
            final = not more
            window += more
        if at >= len(window):
            break
        try:
            found, size = unpacked(window, at, final) if window[at : at + 3] == MEMBER else parsed(window, at, final)
        except NeedsMore:
            if len(window) - at >= 2 * MOST_RECORD:
                raise
            want = 2 * (len(window) - at)
            continue
        except Damaged as e:
            if gap is None:
                gap, reason = base + at, str(e)
            places = [p for p in (window.find(MEMBER, at + 1), window.find(b"WARC/1.", at + 1)) if p > 0]
            at = min(places) if places else len(window) if final else max(at + 1, len(window) - 6)
            want = READ_BYTES
        else:
            if gap is not None:
                yield gap, base + at - gap, None, reason
                gap = None
            yield base + at, size, found, None
            at, want = at + size, READ_BYTES
        if at > len(window) // 2:
            base += at
            del window[:at]
            at = 0
    if gap is not None:
        yield gap, base + at - gap, None, reason


def filesystem(uri: str):
    """The file system of a URI, local or remote, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + uri)


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), refers_to and revisit. Narrow rows settle the groups; pages are shuffled once."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    named = own.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    groups = named.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    narrow = named.select("page_id", "digest", "size").join(groups, ["digest", "size"]).where("page_id is null or page_id < last").select("page_id", "digest", "last").distinct()
    same = named["page_id"].eqNullSafe(F.col("r.id")) & (named["digest"] == F.col("r.sum"))
    joined = named.join(narrow.select(F.col("page_id").alias("id"), F.col("digest").alias("sum"), "last").alias("r"), same, "left")
    return joined.select("page_id", "url", "html", F.col("last").alias("refers_to"), F.col("last").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, folder: str, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' records under the folder; path, n_records and n_bytes of each archive, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        system.create_dir(top, recursive=True)
        task, number, out = TaskContext.get(), 0, None

        def close():
            out.close()
            system.move(hidden, path)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([total])], ["path", "n_records", "n_bytes"])

        for batch in sliced(batches, "html"):
            rows = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit")]
            for page_id, url, refers_to, revisit, html in zip(*rows, texts(batch.column("html")).to_pylist()):
                if out is None:
                    # The attempt is part of the name: a second attempt never writes over what a first one has reported.
                    name = f"pages-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                    path, hidden = f"{top}/{name}", f"{top}/.{name}.part"
                    out, n, total = system.open_output_stream(hidden, compression=None), 0, 0
                data = member(record(page_id, url, html.encode(), refers_to, revisit))
                out.write(data)
                n, total = n + 1, total + len(data)
                if total >= size:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return written(roles(pages).mapInArrow(run, FILES), "archives")


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """RECORDS of the archives at the paths given: kind record, or kind gap with the offset, length and reason of a quarantined stretch."""
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def columns(path, offset, length, found, reason):
        if found is None:
            return (path, offset, length, "gap", reason, *[None] * (7 if with_payload else 6))
        head, body = found.headers, found.block
        http, _, payload = body.partition(b"\r\n\r\n")
        kind = head.get("warc-type")
        size, digest = len(payload), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "revisit":
            told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(told[0]) if told and told[0].isdigit() else None
        elif digest:  # what the archive holds counts, not what its header says
            digest = sha1_base32(payload)
        out = (path, offset, length, "record", None, page_of(head.get("warc-record-id")), kind, head.get("warc-target-uri"), size, digest, page_of(head.get("warc-refers-to")))
        return (*out, payload) if with_payload else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], names=kinds.names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = filesystem(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None, buffer_size=READ_BYTES) as file:
                    for offset, length, found, reason in salvaged(file.read):
                        rows.append(columns(path, offset, length, found, reason))
                        held += length
                        if len(rows) >= 2000 or with_payload and held > READ_BYTES:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.select("path").repartition("path").mapInArrow(run, schema)


def op6(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A row for each page, as read back from its archives; an error if they do not give as many records as were written."""
    folder = f"{shared_dir(spark)}/gridloom/warc-{uuid.uuid4().hex}"
    files = write_archives(pages, folder)
    found = written(read_archives(files, with_payload=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    n, expected = found.count(), files.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    if n != expected:
        raise RuntimeError(f"{expected} records were written to {folder}, {n} were read back")
    return found
