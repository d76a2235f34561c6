"""WARC archives: a deduplicating writer, and a reader that salvages what damage leaves readable."""

from __future__ import annotations

import re
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 100
#: At most so many records share one file, so that a reader's task holds a bounded one.
FILE_RECORDS = 10_000
_PIECE = 16_384
_CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int
    end: int


# ---- writing


def _record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


_EMPTY_MEMBER = _gzip(b"")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One gzip member per record, without its last byte, which the text writer puts back as line separator.

    That byte is 0: the member's length field ends with it below 16 MB; longer ones get an empty member after them.
    """
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            member = _gzip(_record(*row))
            out.append((member if member.endswith(b"\0") else member + _EMPTY_MEMBER)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str) -> None:
    """``pages`` (``page_id, url, html``) as ``.warc.gz`` data, one gzip member per record, in files below ``path``.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest ``page_id`` is a
    response (all rows that hold this id, if repeated); the others are revisits that name it. Digests meet in an
    aggregate and a join of ids and digests, which Spark can split where one payload holds many rows. Null html is an
    empty payload, a null url leaves its header out; a null id takes part as a revisit only where another id exists.
    Files hold at most ``FILE_RECORDS`` records and are written by Spark, so any store it writes to will do.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = first.filter("n > 1 and first is not null").select("digest", "first")
    # an outer join whose left side Spark splits where one payload holds many rows
    marked = rows.join(shared, "digest", "left")
    refers = F.when(
        (F.octet_length("payload") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")
    )
    records = marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    (
        records.mapInArrow(_members, "member binary")
        .select(F.col("member").cast("string"))
        .write.option("lineSep", "\0")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


# ---- reading


def _differs(digest: str, data: bytes) -> bool:
    """Whether ``algorithm:value``, in hexadecimal or base 32, is not the digest of ``data``; others are not checked."""
    name, _, value = digest.partition(":")
    kind = {"sha1": sha1, "sha-1": sha1, "sha256": sha256, "sha-256": sha256}.get(name.lower())
    if kind is None:
        return False
    found = kind(data)
    return value.lower() != found.hexdigest() and value.upper().rstrip("=") != b32encode(found.digest()).decode().rstrip("=")


class _Scan:
    """The header lines looked at last. Another version line among them is judged without reading them again."""

    def __init__(self, data: bytes):
        self.data, self.start, self.stop = data, 0, -1

    def lines(self, at: int) -> Iterator[tuple[int, str, str]]:
        """Place, name and value of each header line from ``at`` on."""
        while (stop := self.data.find(b"\r\n", at)) > at:
            name, _, value = self.data[at:stop].partition(b":")
            yield at, name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip()
            at = stop + 2

    def block(self, at: int) -> tuple[int, int] | None:
        """Start and length of the block of a record with header lines from ``at`` on, None if it does not hold."""
        if not self.start <= at <= self.stop:
            self._read(at)
        # of repeated headers the last counts, which all version lines before it share
        if self.body is None or self.length_at < at:
            return None
        if self.digest_at >= at:
            if self.differs is None:
                self.differs = _differs(self.digest, self.data[self.body : self.body + self.length])
            if self.differs:
                return None
        return self.body, self.length

    def _read(self, at: int) -> None:
        data, self.start, self.body, self.differs = self.data, at, None, None
        self.length_at = self.digest_at = -1
        while (stop := data.find(b"\r\n", at)) > at and data.find(b":", at, stop) >= 0:
            at = stop + 2
        self.stop = at
        if stop != at:  # ended by a line that is no header, or by the end of the data
            return
        length = ""
        for place, name, value in self.lines(self.start):
            if name == "content-length":
                self.length_at, length = place, value
            elif name == "warc-block-digest":
                self.digest_at, self.digest = place, value
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            return
        self.length = int(length)
        end = at + 2 + self.length
        if data[end : end + 4] == b"\r\n\r\n":
            self.body = at + 2


def _parse(scan: _Scan, at: int) -> Record | None:
    """The record that begins at ``at``, or None unless its framing and its block digest hold."""
    head = _VERSION_LINE.match(scan.data, at)
    found = scan.block(head.end()) if head else None
    if not found:
        return None
    body, length = found
    headers = {name: value for _, name, value in scan.lines(head.end())}
    return Record(headers, scan.data[body : body + length], at, body + length + 4)


def _plain(data: bytes) -> Iterator[Record | tuple[int, int]]:
    """Records, and (start, end) of byte gaps that hold none."""
    at, scan = 0, _Scan(data)
    while at < len(data):
        record = _parse(scan, at)
        if record:
            yield record
            at = record.end
            continue
        # resume at the next version line that begins a whole record
        resume = at + 1
        while (found := _VERSION_LINE.search(data, resume)) and not _parse(scan, found.start()):
            resume = found.start() + 1
        end = found.start() if found else len(data)
        yield at, end
        at = end


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``, None unless its checksum and length hold."""
    if data[at : at + 3] != MEMBER:
        return None
    inflater, parts, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not inflater.eof:  # by pieces, as what follows the member is handed back
            parts.append(inflater.decompress(data[end : end + _PIECE]))
            end = min(end + _PIECE, len(data))
    except zlib.error:
        return None
    return (b"".join(parts), end - len(inflater.unused_data)) if inflater.eof else None


def salvage(data: bytes) -> Iterator[Record | tuple[int, int]]:
    """Every whole record of an archive in order, and between them the quarantined gaps as (start, end).

    Both plain and gzip archives are read. Where a check fails (framing, lengths, member checksum, block digest), the
    search goes on one byte later for the next gzip member or version line that passes them all. The gaps and
    the records (for gzip their members) cover every byte once. Header lines are read once however many version
    lines lie among them, and a block is hashed once per set of header lines, so a damaged stretch takes time in
    proportion to its length unless it nests whole records that fail their digests.
    """
    if MEMBER not in data:
        yield from _plain(data)
        return
    at, bad, version, next_member, scan = 0, None, -1, -1, _Scan(data)
    while at < len(data):
        member = _inflate(data, at)
        parsed = list(_plain(member[0])) if member else []
        plain = None if member else _parse(scan, at)
        if member and all(isinstance(r, Record) for r in parsed):
            if bad is not None:
                yield bad, at
                bad = None
            for r in parsed:
                yield Record(r.headers, r.block, at, member[1])
            at = member[1]
        elif plain:
            if bad is not None:
                yield bad, at
                bad = None
            yield plain
            at = plain.end
        elif member and any(isinstance(r, Record) for r in parsed):
            # a sound member around partly unsound records: what is sound counts, the member is logged
            yield (at if bad is None else bad), member[1]
            bad = None
            yield from (Record(r.headers, r.block, at, member[1]) for r in parsed if isinstance(r, Record))
            at = member[1]
        else:
            bad = at if bad is None else bad
            if next_member <= at:
                found_at = data.find(MEMBER, at + 1)
                next_member = found_at if found_at >= 0 else len(data)
            if version <= at:
                found = _VERSION_LINE.search(data, at + 1)
                version = found.start() if found else len(data)
            at = min(version, next_member)
    if bad is not None:
        yield bad, len(data)


READ_SCHEMA = (
    "file string, start bigint, end bigint, record_type string, record_id string, url string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def _http(block: bytes) -> tuple[int | None, bool, bytes]:
    """Announced length of an HTTP message, whether it is sent in chunks, and its body."""
    head, _, body = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    chunked = re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) is not None
    return (int(found[1]) if found and not chunked else None), chunked, body


def _joined(body: bytes) -> bytes | None:
    """The content of a body in chunks, None if it is not one (crawlers may join chunks and keep the header)."""
    parts, at = [], 0
    while found := _CHUNK_SIZE.match(body, at):
        n, at = int(found[1], 16), found.end()
        if n == 0:
            return b"".join(parts)
        parts.append(body[at : at + n])
        at += n + 2
        if body[at - 2 : at] != b"\r\n":
            return None
    return None


def _payload(r: Record) -> tuple[int | None, bytes | None] | None:
    """Length and bytes of a record's payload; None if the record contradicts what it says of it.

    The payload is the body of an HTTP message without its chunk marks, else the block. A revisit has none, and only
    its announced length counts. Parts of a payload (truncated or segmented records) are not held against lengths and
    digests of the whole.
    """
    h, kind = r.headers, r.headers.get("warc-type")
    digest = h.get("warc-payload-digest", "")
    said = h.get("content-type", "http" if kind in ("response", "revisit") and r.block.startswith(b"HTTP/") else "")
    http = said.lower().startswith(("application/http", "http")) and kind != "continuation"
    length, chunked, body = _http(r.block) if http else (None, False, r.block)
    if kind == "revisit":
        return length, None
    joined = _joined(body) if chunked else None
    payload = body if joined is None else joined
    if not {"warc-truncated", "warc-segment-number"} & h.keys():
        if length is not None and length != len(body):
            return None
        # writers differ in whether the digest is of the body as it was sent
        if _differs(digest, payload) and _differs(digest, body):
            return None
    return len(payload), payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()),
        ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, held = [], 0
            for r in salvage(content.as_buffer().to_pybytes()):
                if isinstance(r, tuple):
                    rows.append((file, *r, "quarantined", None, None, None, None, None, None))
                    continue
                kind, h = r.headers.get("warc-type"), r.headers
                found = _payload(r)
                if found is None:
                    rows.append((file, r.start, r.end, "quarantined", None, None, None, None, None, None))
                    continue
                digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
                rows.append((
                    file, r.start, r.end, kind, h.get("warc-record-id"), h.get("warc-target-uri"),
                    h.get("warc-refers-to"), digest or None, *found,
                ))
                held += len(r.block)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of the archives below ``path``, a row each.

    ``file, start, end`` tell where it lay (bytes; in gzip archives the member); ``record_type`` is the record's or
    ``quarantined`` for a gap in which no check passed. ``payload_bytes`` is the full payload's length, also for
    revisits that tell it, whose ``payload`` is null. ``payload_digest`` is as written, SHA-256 without its prefix. A task reads one file at a time as a whole; see ``FILE_RECORDS``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, READ_SCHEMA)


def page_records(archived: DataFrame) -> DataFrame:
    """Per page record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""

    def page(column: str):
        return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:page:(.*)>$', 1), '') as bigint)")

    return archived.filter(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )
