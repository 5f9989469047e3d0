"""WARC records in ZIP archives: round trips and the directory parser."""

import gzip
import hashlib
import io
import struct
import zipfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from anchorset.llm import warc

PAGES = "page_id bigint, url string, html string"


def expected(rows):
    """type and target of every row by the contract."""
    data = {i: (html or "").encode() for i, _, html in rows}
    owner = {}
    for i, payload in data.items():
        if len(payload) >= 1000:
            owner[payload] = max(owner.get(payload, i), i)
    out = {}
    for i, payload in data.items():
        own = owner.get(payload, i) == i
        out[i] = (len(payload), hashlib.sha1(payload).hexdigest(), "response" if own else "revisit", None if own else owner[payload])
    return out


def test_round_trip(spark, clashing):
    big = "é" * 500  # 1000 bytes
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "u", big), (3, "u", "x" * 999), (4, "u", "x" * 999),
            (5, None, None), (6, "u\r\nX: y", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 99), (8, "u", "z" * 3_000_000)]
    found = warc.round_trip(clashing(spark.createDataFrame(rows, PAGES))).collect()
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found}
    assert len(found) == len(rows) and got == expected(rows)


def test_hot_payload_is_split_and_whole(spark):
    rows = [(i, f"u{i}", "h" * 1500 if i % 3 else f"{i}" * 400) for i in range(900)]
    df = spark.createDataFrame(rows, PAGES)
    typed = warc.record_types(df, "page_id", "html", hot_rows=50).collect()
    want = expected(rows)
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in typed} == {i: v[2:] for i, v in want.items()}


def test_repeated_rows_and_null_ids(spark):
    big = "b" * 1000
    rows = [(1, "u", big), (1, "u", big), (None, "u", big), (None, "v", "c" * 1000)]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    # A row that would revisit its own id is a response; a null id revisits.
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found) == [
        (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_payload_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x", "påyload\r\n\r\n"), (2, "http://y", None)], PAGES)
    folder = str(tmp_path / "archives")
    archives = spark.createDataFrame(warc.write_archives(df, folder).collect())
    found = {r["id"]: bytes(r["payload"]) for r in warc.read_archives(spark, archives, folder, texts=True).collect()}
    assert found == {"1": "påyload\r\n\r\n".encode(), "2": b""}
    # Other programs can read the archive: stored members, one gzip member per record.
    for path in (tmp_path / "archives").iterdir():
        with zipfile.ZipFile(path) as archive:
            assert {i.compress_type for i in archive.infolist()} == {zipfile.ZIP_STORED}
            assert gzip.decompress(archive.read(warc.DATA)).startswith(b"WARC/1.1")


def test_each_archive_is_read_by_its_own_task(spark, tmp_path):
    folder, listed = str(tmp_path / "archives"), []
    for k in range(6):
        rows = [(10 * k + i, f"http://x/{i}", f"page {k} {i}") for i in range(5)]
        listed += warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), folder).collect()
    archives = spark.createDataFrame(listed)
    paths = archives.select("path").distinct().count()
    found = warc.read_archives(spark, archives, folder).withColumn("task", F.spark_partition_id())
    assert paths >= 6 and found.select("task").distinct().count() == paths
    assert found.count() == 30


def test_many_archives_per_task(spark, monkeypatch, tmp_path):
    rows = [(i, "u", f"{i}" * 500) for i in range(40)]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    fs, folder = warc.filesystem(str(tmp_path))
    archive = warc._Archive(fs, folder)
    for i, url, html in rows:
        archive.add(i, url, html.encode(), hashlib.sha1(html.encode()).hexdigest(), "response", None)
    reader = warc.RangeReader(fs, archive.close())
    assert sorted(payload for _, _, payload in warc.records(reader)) == sorted(html.encode() for *_, html in rows)


def _zip64(name: bytes, data: bytes, comment: bytes = b"") -> bytes:
    """An archive whose sizes and offsets all stand in ZIP64 fields."""
    full = 0xFFFFFFFF
    wide = struct.pack("<HHQQ", 1, 16, len(data), len(data))
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, full, full, len(name), len(wide)) + name + wide + data
    extra = struct.pack("<HH3s", 0x7075, 3, b"abc") + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, full, full, len(name), len(extra), 0, 0, 0, 0, full)
    central += name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, full, full, len(comment)) + comment
    return local + central + end64 + locator + end


@pytest.mark.parametrize("comment", [b"", b"a note", b"PK\5\6" + b"x" * 40])
def test_zip64_directory(tmp_path, comment):
    data = b"some stored bytes"
    (tmp_path / "a.zip").write_bytes(_zip64(b"archive/x", data, comment))
    reader = warc.RangeReader(pafs.LocalFileSystem(), str(tmp_path / "a.zip"))
    member = warc.directory(reader)["archive/x"]
    start = warc.stored_start(reader, member)
    assert member.size == member.packed == len(data) and reader.read(start, member.size) == data


def test_directory_of_an_ordinary_archive(tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("a", b"one")
        archive.writestr(zipfile.ZipInfo("b"), b"two" * 100, zipfile.ZIP_DEFLATED)
        archive.comment = b"hello"
    (tmp_path / "b.zip").write_bytes(held.getvalue())
    reader = warc.RangeReader(pafs.LocalFileSystem(), str(tmp_path / "b.zip"))
    members = warc.directory(reader)
    assert {n: m.size for n, m in members.items()} == {"a": 3, "b": 300}
    with pytest.raises(ValueError):
        warc.stored_start(reader, members["b"])


def test_damaged_archives(tmp_path):
    (tmp_path / "c.zip").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        warc.directory(warc.RangeReader(pafs.LocalFileSystem(), str(tmp_path / "c.zip")))
