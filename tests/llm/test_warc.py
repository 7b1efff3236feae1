import base64
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.session import scratch_path


def archive(members, zip64=False, before=b"", comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "a" if before else "w", method) as z:
        for name, data in members.items():
            with z.open(name, "w", force_zip64=zip64) as f:
                f.write(data)
        z.comment = comment
    data = out.getvalue()
    return warc.ZipArchive(io.BytesIO(data), len(data))


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("before", [b"", b"a stub in front"])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 not the end", b"x" * 60_000])
def test_directories_and_ranges(zip64, before, comment):
    members = {"a.warc": bytes(range(256)) * 9, "dir/é.idx": b"", "b": b"PK\5\6PK\1\2"}
    z = archive(members, zip64, before, comment)
    assert set(z.members) == set(members)
    for name, data in members.items():
        assert z.read(name) == data
    assert z.read("a.warc", 300, 77) == members["a.warc"][300:377]
    with pytest.raises(ValueError):
        z.read("a.warc", 2300, 77)


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)  # makes the writer add the ZIP64 end record
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # and 64-bit sizes and offsets in the directory
    members = {f"m{i}": bytes([i]) * 150 for i in range(5)}
    z = archive(members, True)
    assert {n: z.read(n) for n in z.members} == members


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.ZipArchive(io.BytesIO(b"x" * 100), 100)
    with pytest.raises(ValueError, match="stored"):
        archive({"a": b"x" * 1000}, method=zipfile.ZIP_DEFLATED).read("a")


def test_records():
    data = warc.record(7, "http://a/ü\r\nx y", b"pay\r\n\r\nload", None, "d")
    found = warc.parse(data)
    assert (found["page_id"], found["payload"], found["record_type"], found["url"]) == (7, b"pay\r\n\r\nload", "response", "http://a/%C3%BC%0D%0Ax%20y")
    again = warc.parse(warc.record(9, None, b"pay\r\n\r\nload", 7, "d"))
    assert (again["refers_to"], again["payload_bytes"], again["payload"], again["payload_digest"]) == (7, 11, b"", found["payload_digest"])
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"\nload", b"\nlost"))


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        refers = None if len(data) < least or page == f else f
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [(5, "http://a", "<p>ü</p>"), (3, None, "<p>ü</p>"), (9, "http://b", None), (8, "", ""), (2, "u", "x" * 3_000_000), (11, "u", "x" * 3_000_000), (4, "c", "one"), (4, "c", "one"),
        (None, "n", "<p>ü</p>"), (None, None, "alone"), (1, "line\nbreak", "a\r\n\r\nb")]
CLASH = ("sha", "first", "page", "payload", "s", "n", "path", "records")


@pytest.mark.parametrize("least", [0, 4, 1 << 40])
@pytest.mark.parametrize("records", [2, 20_000])
def test_round_trip(spark, least, records, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", records)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").select("*", *(F.lit(1).alias(c) for c in CLASH))
    found = warc.round_trip(pages, least=least).drop("url").collect()
    assert sorted(map(tuple, found), key=str) == expected(ROWS, least)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_runs_cover_every_record_and_payloads_come_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = warc.write_archives(pages, scratch_path(spark, "archives"))
    back = warc.read_archives(manifest, run_length=7)
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in back.collect()) == sorted((r.page_id, r.html) for r in pages.collect())
    assert sorted(map(tuple, warc.read_archives(manifest, False, 7).drop("url").collect()), key=str) == expected([tuple(r) for r in pages.collect()])
