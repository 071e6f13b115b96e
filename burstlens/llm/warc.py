"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer puts one record into each gzip member (or writes records plainly). Of pages
with the same payload of at least ``LEAST_SHARED`` bytes, the one with the least id is a
response and the others are revisit records that refer to it, without the payload.
Groups of equal payloads are found from digests alone; they are joined to the pages by
digest, which Spark broadcasts only if it finds them small, and splits where skewed.

The reader checks each record: the member's checksum, the version line, the header, the
lengths, and the payload digest. After a failed check it searches for the next member
that begins with a version line, or the next version line of a plain file, goes on from
there, and reports the bytes between as a quarantined gap. It holds one record and
one read at a time, whatever the size of the file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.llm.token_files import opened
from burstlens.llm.places import prepare

LEAST_SHARED = 100
# Files are closed at about this many bytes.
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20

#: Fixed values of the format.
VERSION = b"WARC/1.1"
ANY_VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"1970-01-01T00:00:00Z"
ID_PREFIX = b"urn:page:"

RECORD = (
    "file string, start long, end long, gap string, record_id string, record_type string, "
    "uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
)
_RECORD = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()),
     ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()),
     ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("payload", pa.binary())]
)


def record(
    page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """One record, not compressed. ``refers_to`` makes it a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = b"" if page_id is None else b"%d" % page_id
    lines = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <" + ID_PREFIX + name + b">",
        b"WARC-Date: " + DATE,
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
    ]
    if uri is not None:
        # A header line cannot hold line ends.
        safe = uri.replace("\r", "%0D").replace("\n", "%0A").encode()
        lines.append(b"WARC-Target-URI: " + safe)
    if refers_to is not None:
        lines.append(b"WARC-Refers-To: <" + ID_PREFIX + b"%d" % refers_to + b">")
        lines.append(b"WARC-Profile: " + PROFILE)
    lines.append(b"Content-Type: application/http;msgtype=response")
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A record as a gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_references(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``(page_id, uri, payload, digest, refers_to)`` of each page."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    named = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("uri"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    shared = (
        named.filter(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return named.join(shared, "digest", "left").select(
        "page_id", "uri", "payload", "digest", F.when(other, F.col("first")).alias("refers_to")
    )


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    html: str = "html",
    compressed: bool = True,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write a record for each page into WARC files under ``path``.

    A null payload is empty, a null ``url`` gives no target; further columns are not
    written. Null ids are written without a number and never referred to. Rows of the
    same id and payload are a response each. Tasks write files of their own, and only those
    in ``manifest/`` count, so retries leave no double records.
    """
    prepare(pages.sparkSession)
    pack = member if compressed else bytes
    suffix = "warc.gz" if compressed else "warc"

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        out, size, rows, files = None, 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        stem = f"part-{task.partitionId():08d}-{task.taskAttemptId()}"
                        name = f"{stem}-{uuid.uuid4().hex[:8]}.{suffix}"
                        # The name ends in .gz, but records are packed one by one here.
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        size, rows = 0, 0
                    raw = pack(
                        record(row["page_id"], row["uri"], row["payload"], row["digest"], row["refers_to"])
                    )
                    out.write(raw)
                    size, rows = size + len(raw), rows + 1
                    if size >= file_bytes:
                        out.close()
                        files.append({"name": name, "size": size, "records": rows})
                        out = None
        if out is not None:
            out.close()
            files.append({"name": name, "size": size, "records": rows})
        schema = pa.schema([("name", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
        yield pa.RecordBatch.from_pylist(files, schema=schema)

    rows = with_references(pages, page_id, html)
    rows.mapInArrow(write, "name string, size long, records long").write.parquet(f"{path}/manifest")


class _Source:
    """Bytes of a file by position, read in pieces."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()
        self.at, self.held = 0, b""

    def read(self, start: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``start``."""
        size = min(size, self.size - start)
        if start < self.at or start + size > self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(
                min(max(size, READ_BYTES), self.size - start), start
            )
        return self.held[start - self.at : start - self.at + size]

    def find(self, what: bytes, start: int) -> int:
        """The first place of ``what`` from ``start`` on, or -1."""
        while start < self.size:
            piece = self.read(start, READ_BYTES)
            at = piece.find(what)
            if at >= 0:
                return start + at
            start += max(1, len(piece) - len(what) + 1)
        return -1


class Damaged(Exception):
    """A record failed a check."""


def _unpacked(source: _Source, start: int) -> tuple[bytes, int]:
    """The content of the member at ``start`` and where it ends."""
    unpacker, parts, at = zlib.decompressobj(31), [], start
    try:
        while not unpacker.eof:
            piece = source.read(at, 1 << 16)
            if not piece:
                raise Damaged("member is cut off")
            parts.append(unpacker.decompress(piece))
            at += len(piece)
    except zlib.error as e:
        raise Damaged(f"member: {e}") from e
    return b"".join(parts), at - len(unpacker.unused_data)


def _headers(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(ANY_VERSION):
        raise Damaged("no version line")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        found[name.strip().lower()] = value.strip()
    return found


def _length(headers: dict[bytes, bytes]) -> int:
    value = headers.get(b"content-length", b"")
    if not value.isdigit():
        raise Damaged("no content length")
    return int(value)


def _plain(source: _Source, start: int) -> tuple[bytes, int]:
    """The plain record at ``start`` and where it ends."""
    if source.read(start, len(ANY_VERSION)) != ANY_VERSION:
        raise Damaged("no version line")
    end = source.find(b"\r\n\r\n", start)
    if end < 0:
        raise Damaged("header is cut off")
    stop = end + 8 + _length(_headers(source.read(start, end - start)))
    if stop > source.size:
        raise Damaged("record is cut off")
    return source.read(start, stop - start), stop


def _fields(raw: bytes) -> dict:
    """What a record says, after checking it."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise Damaged("header is cut off")
    headers = _headers(head)
    size = _length(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged("content length differs")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind = headers.get(b"warc-type", b"").decode("latin-1")
    method, _, digest = headers.get(b"warc-payload-digest", b"").decode("latin-1").partition(":")
    if kind == "revisit":
        inner = _headers(ANY_VERSION + b"1\r\n" + http.partition(b"\r\n")[2])
        n = _length(inner)
        payload = None
    else:
        n, found = len(payload), hashlib.sha256(payload).hexdigest()
        if method == "sha256" and digest != found:
            raise Damaged("payload digest differs")
        digest = found
    text = lambda name: headers[name].decode("utf-8", "replace") if name in headers else None
    return {
        "record_id": text(b"warc-record-id"), "record_type": kind,
        "uri": text(b"warc-target-uri"), "refers_to": text(b"warc-refers-to"),
        "payload_bytes": n, "payload_digest": digest, "payload": payload,
    }


def _next_start(source: _Source, start: int) -> int:
    """Where the next valid member or version line begins, from ``start`` on; else the end."""
    member_at = source.find(MEMBER, start)
    while member_at >= 0:
        head = zlib.decompressobj(31)
        try:
            if head.decompress(source.read(member_at, 1 << 12), 64).startswith(ANY_VERSION):
                break
        except zlib.error:
            pass
        member_at = source.find(MEMBER, member_at + 1)
    plain_at = source.find(b"\n" + ANY_VERSION, start)
    found = [x for x in (member_at, plain_at + 1 if plain_at >= 0 else -1) if x >= 0]
    return min(found, default=source.size)


def salvage(file, name: str, with_payload: bool = False):
    """Records and gaps of one open file, in order, as rows of ``RECORD``."""
    source, at = _Source(file), 0
    while at < source.size:
        row = {"file": name, "start": at}
        try:
            packed = source.read(at, 3) == MEMBER
            raw, end = (_unpacked if packed else _plain)(source, at)
            row |= _fields(raw)
        except Damaged as e:
            end = _next_start(source, at + 1)
            row["gap"] = str(e)
        row["end"] = at = end
        if not with_payload:
            row.pop("payload", None)
        yield row


def read_warc(
    spark: SparkSession, path: str, with_payload: bool = False, names: DataFrame | None = None
) -> DataFrame:
    """Records and quarantined gaps of the files under ``path``.

    A row with ``gap`` null is a record; otherwise ``gap`` says why the bytes from ``start`` to
    ``end`` could not be read. ``names`` (column ``name``) replaces the manifest.
    """
    prepare(spark)

    def read(batches):
        fs, root = opened(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    rows, held = [], 0
                    for row in salvage(f, name, with_payload):
                        rows.append(row)
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 2048 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    listed = names if names is not None else spark.read.parquet(f"{path}/manifest")
    # A file is a task's work. Their number is given, or the small manifest would be one task's.
    return listed.select("name").repartitionByRange(max(1, listed.count()), "name").mapInArrow(read, RECORD)


def page_number(column):
    """The page id in a record id."""
    return F.regexp_extract(column, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
