"""WARC records in ZIP-packaged archives, read by byte ranges.

Writing: every task packs its rows into one ZIP file that holds two stored (not
compressed) members, ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (sorted lines: key and a JSON object with digest, offset
and length). A file is written under a name of its own and then renamed, and
its path is returned as a row; retried or speculative tasks leave complete files
that no row names.

Reading: the end records and the central directory (ZIP64 too) are parsed from
byte ranges, stored members located by their local headers, the index read in
blocks, and each record fetched by its range. Nothing is extracted, and no
archive is read as a whole.

Records: of rows with equal payloads of at least ``LEAST_SHARED`` bytes the one
with the largest id is a response and the others revisit it; smaller payloads
are all responses. A revisit carries the HTTP header (with the full length) and
the digest, but no payload. Null html is an empty payload. Rows with equal ids
and payloads are each written; a row that revisits its own id is a response
too. A null id is never referred to. An empty table gives no archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import subject_join
from ..sources.stages import StageStore
from .text import clash_free, kind_of

LEAST_SHARED = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
# Index lines and records are fetched in runs of about this many bytes.
RUN_BYTES = 1 << 20
# An archive is closed at this size and the next one begun.
ARCHIVE_BYTES = 1 << 28

# Record signatures and field layouts of the ZIP format.
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


# -- record types ------------------------------------------------------------


def record_types(
    pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST_SHARED, hot_rows: int = 200_000
) -> DataFrame:
    """The pages with payload_bytes, payload_digest, record_type and refers_to.

    Only digests that occur more than once are joined back; a digest with many
    rows is cut into parts there."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn(
        "payload_digest", F.sha1(payload)
    )
    owner = (
        rows.filter((F.col("payload_bytes") >= least) & F.col(id_col).isNotNull())
        .groupBy("payload_digest")
        .agg(F.max(id_col).alias("_owner"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("payload_digest", "_owner")
    )
    joined = subject_join(rows, owner, "payload_digest", "left", hot_rows)
    again = F.col("_owner").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_owner"))
    return joined.select(
        *(F.col(f"`{c}`") for c in rows.columns),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_owner")).alias("refers_to"),
    )


# -- writing -----------------------------------------------------------------


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _uri(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id, url: str, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    block = _http(len(payload)) + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_uri(page_id)}#{digest}')}>",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Concurrent-To: <{_uri(page_id)}>",
    ]
    if record_type == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_uri(refers_to)}>",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _one_line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all workers share."""
    scheme, _, rest = uri.partition("://")
    if not rest:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return pafs.FileSystem.from_uri(uri)


class _Archive:
    """One ZIP file under way: the records' bytes go to the store as they come."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.fs, self.path = fs, f"{folder}/{uuid.uuid4().hex}.wacz"
        self.sink = fs.open_output_stream(f"{self.path}.part")
        self.zip = zipfile.ZipFile(_Appending(self.sink), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, url, payload, digest, record_type, refers_to) -> None:
        data = gzip.compress(record(page_id, url, payload, digest, record_type, refers_to), 1, mtime=0)
        self.member.write(data)
        entry = {"url": url, "digest": f"sha1:{digest}", "offset": self.at, "length": len(data), "type": record_type}
        self.lines.append(f"{_one_line(url)} {DATE} {json.dumps(entry)}\n")
        self.at += len(data)

    def close(self) -> str:
        self.member.close()
        info = zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0))
        with self.zip.open(info, "w", force_zip64=True) as member:
            for line in sorted(self.lines):
                member.write(line.encode())
        self.zip.close()
        self.sink.close()
        self.fs.move(f"{self.path}.part", self.path)
        return self.path


class _Appending(io.RawIOBase):
    """A sink that only appends, as object stores do."""

    def __init__(self, sink):
        self.sink, self.count = sink, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        self.count += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write all pages and return (path, records) per archive. Run it once: the
    result is meant to be stored before archives are read."""
    rows = record_types(clash_free(pages, id_col, url_col, payload_col), id_col, payload_col)
    root = folder

    def run(batches: Iterator[pa.RecordBatch]):
        fs, folder = filesystem(root)
        fs.create_dir(folder, recursive=True)
        archive, done = None, []
        for batch in batches:
            # One row at a time, so that a batch is not held twice.
            for i in range(batch.num_rows):
                page_id, url, html, _, digest, kind, refers_to = (c[i].as_py() for c in batch.columns)
                archive = archive or _Archive(fs, folder)
                archive.add(page_id, url, (html or "").encode(), digest, kind, refers_to)
                if archive.at >= ARCHIVE_BYTES:
                    done.append((archive.close(), len(archive.lines)))
                    archive = None
        if archive:
            done.append((archive.close(), len(archive.lines)))
        columns = list(zip(*done, strict=True)) if done else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["path", "records"])

    return rows.mapInArrow(run, "path string, records bigint")


# -- reading -----------------------------------------------------------------


@dataclass
class Member:
    """A member's place: where its local header starts, and its size."""

    name: str
    method: int
    header: int
    size: int
    packed: int


class RangeReader:
    """Byte ranges of one file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, length: int) -> bytes:
        if at < 0 or at + length > self.size:
            raise ValueError("a range lies outside the archive")
        return self.file.read_at(length, at)

    def close(self) -> None:
        self.file.close()


def directory(reader: RangeReader) -> dict[str, Member]:
    """The members named by the central directory."""
    tail_at = max(0, reader.size - 22 - 0xFFFF)
    tail = reader.read(tail_at, reader.size - tail_at)
    end = tail.rfind(_END)
    # A comment may hold the signature: the right record is the one whose comment ends the file.
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP file")
    entries, size, start = struct.unpack_from("<HII", tail, end + 10)
    if entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator_at = tail_at + end - 20
        signature, _, at64, _ = struct.unpack("<4sIQI", reader.read(locator_at, 20))
        if signature != _LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        record64 = reader.read(at64, 56)
        if record64[:4] != _END64:
            raise ValueError("the ZIP64 end record is missing")
        entries, size, start = struct.unpack_from("<QQQ", record64, 32)
    data, at, found = reader.read(start, size), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain = struct.unpack_from("<II", data, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = _wide_fields(extra)
        # The 64-bit field holds, in this order, only the values that do not fit.
        plain, wide = _take(plain, wide)
        packed, wide = _take(packed, wide)
        header, wide = _take(header, wide)
        found[name] = Member(name, method, header, plain, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def _wide_fields(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4 : at + 4 + length]
        at += 4 + length
    return b""


def _take(value: int, wide: bytes) -> tuple[int, bytes]:
    if value != 0xFFFFFFFF or len(wide) < 8:
        return value, wide
    return int.from_bytes(wide[:8], "little"), wide[8:]


def stored_start(reader: RangeReader, member: Member) -> int:
    """Where a stored member's bytes begin, from its local header."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed, so its records have no ranges")
    header = reader.read(member.header, 30)
    if header[:4] != _LOCAL:
        raise ValueError("a local header is missing")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


def index_entries(reader: RangeReader, member: Member) -> Iterator[dict]:
    """Index lines, fetched in blocks."""
    start, at, rest = stored_start(reader, member), 0, b""
    while at < member.size:
        block = reader.read(start + at, min(RUN_BYTES, member.size - at))
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if line:
                yield json.loads(line[line.index(b"{") :])
    if rest:
        yield json.loads(rest[rest.index(b"{") :])


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(f.split(": ", 1) for f in fields)
    block = rest[: int(warc["Content-Length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(f.split(": ", 1) for f in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


def records(reader: RangeReader) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """All records of an archive in index order; one range each."""
    members = directory(reader)
    start = stored_start(reader, members[DATA])
    for entry in index_entries(reader, members[INDEX]):
        yield parse_record(gzip.decompress(reader.read(start + entry["offset"], entry["length"])))


def _page_id(uri: str) -> str | None:
    return uri.strip("<>").removeprefix("urn:page:") or None


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, texts: bool = False) -> DataFrame:
    """(id as text, url, payload_bytes, payload_digest, record_type, refers_to
    [, payload]) for every record of the listed archives. Length and digest are
    those of the bytes read for a response, of the full payload as stated in
    the headers for a revisit."""
    root = folder

    def run(batches: Iterator[pa.RecordBatch]):
        fs, _ = filesystem(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader, rows, held = RangeReader(fs, path), [], 0
                for warc, http, payload in records(reader):
                    rows.append(_row(warc, http, payload))
                    held += len(payload)
                    if len(rows) >= 2000 or held > RUN_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)
                reader.close()

    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * texts]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * texts]

    def _row(warc, http, payload):
        if warc["WARC-Type"] == "response":
            length, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if warc["WARC-Payload-Digest"] != f"sha1:{digest}":
                raise ValueError("a payload does not have its digest")
        else:
            length, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:")
        refers = _page_id(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None
        own = _page_id(warc["WARC-Concurrent-To"])
        return own, warc["WARC-Target-URI"], length, digest, warc["WARC-Type"], refers, *[payload] * texts

    def _rows(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    schema += ", payload binary" if texts else ""
    # A task per archive: the few short paths would otherwise be put together.
    paths = archives.select("path").distinct()
    return paths.repartition(max(1, paths.count())).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    kind = kind_of(pages, id_col)
    store = StageStore.for_session(spark)
    folder = f"{store.folder}/archives"
    archives = store.border("archive_list", write_archives(pages, folder, id_col, url_col, payload_col))
    found = read_archives(spark, archives, folder)
    return found.select(
        F.col("id").cast(kind).alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "url",
    )
