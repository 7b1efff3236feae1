"""WARC records in ZIP-packaged archives, and a reader that never unpacks them.

An archive is a ZIP file that stores (method 0) a WARC member, one gzip member a
record, and an index member with each record's offset and length. The reader
reads the end of the file, parses the central or ZIP64 directory, finds where the
stored members lie, and then reads single records by byte range.

Writing: one row of the manifest per finished archive. An archive's name is new
in every attempt of a task, and the manifest is a table that Spark commits, so
what a lost or repeated attempt leaves behind is never read. Reading: archives
are cut into runs of records, so one archive is read by many tasks.

Folders are URIs of a file system that all executors share (file, hdfs, s3, ...).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices
from tessera.session import materialize, scratch_path

#: An archive is closed at so many records or bytes; a reader takes so many records.
RECORDS, BYTES, RUN = 20_000, 512 << 20, 2_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Signatures and layouts of the ZIP format.
_LOCAL, _CENTRAL, _END, _LOCATOR, _END64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\7", b"PK\6\6"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if ":" in uri else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP directories ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int  # as it lies in the archive
    header: int  # offset of the local header


class ZipArchive:
    """Members of a ZIP file and byte ranges of the stored ones; ``file`` has seek and read, like a local or remote file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def read_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError("archive is cut short")
        return out

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - _FULL16)
        tail = self.read_at(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP archive: no end of central directory")
        _, _, _, entries, length, offset = struct.unpack_from("<HHHHII", tail, at + 4)
        end = tail_at + at
        wide = entries == _FULL16 or length == _FULL32 or offset == _FULL32
        locator = self.read_at(end - 20, 20) if end >= 20 else b""
        if locator[:4] == _LOCATOR:
            # where the locator says, or right before it if something was put before the archive
            for at in (struct.unpack_from("<Q", locator, 8)[0], end - 20 - 56):
                if 0 <= at <= self.size - 56 and (found := self.read_at(at, 56))[:4] == _END64:
                    entries, length, offset = struct.unpack_from("<QQQ", found, 32)
                    end, wide = at, False
                    break
        if wide:
            raise ValueError("ZIP64 end of central directory not found")
        before = end - length - offset  # bytes put before the archive
        data, at = self.read_at(offset + before, length), 0
        for _ in range(entries):
            if data[at: at + 4] != _CENTRAL:
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            size, full, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46: at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            size, header = self._wide(data[at + 46 + n: at + 46 + n + extra], full, size, header)
            if flags & 1:
                raise ValueError(f"{name} is encrypted")
            yield Member(name, method, size, header + before)
            at += 46 + n + extra + comment

    @staticmethod
    def _wide(extra: bytes, full: int, size: int, header: int) -> tuple[int, int]:
        """Size and offset, from the ZIP64 field where the 32-bit ones are full."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                if full == _FULL32:
                    next(wide)
                size = next(wide) if size == _FULL32 else size
                header = next(wide) if header == _FULL32 else header
            at += 4 + n
        return size, header

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        if name not in self._starts:
            m = self.members[name]
            if m.method != 0:
                raise ValueError(f"{name} is compressed: only stored members can be read by range")
            local = self.read_at(m.header, 30)
            if local[:4] != _LOCAL:
                raise ValueError("bad local header")
            self._starts[name] = m.header + 30 + sum(struct.unpack_from("<HH", local, 26))
        return self._starts[name]

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        size = self.members[name].size
        n = size - at if n is None else n
        if at < 0 or n < 0 or at + n > size:
            raise ValueError("range outside the member")
        return self.read_at(self.start(name) + at, n)


# --- WARC records -----------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record with the payload, or a revisit record with only its headers."""
    kind = "response" if refers_to is None else "revisit"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}, rest


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def parse(data: bytes) -> dict:
    """A record's page, type, payload and what it says of the payload; a payload that differs from its digest raises."""
    head, rest = _headers(data)
    http, payload = _headers(rest[: int(head["content-length"])])
    said = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and digest(payload) != said:
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return {"page_id": _page(head["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": said,
            "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")), "url": head.get("warc-target-uri"), "payload": payload}


# --- on Spark ------------------------------------------------------------------------------------------------------


class _Writer:
    """One archive being written; nothing but its index is held in memory."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = file_system(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index, self.bytes = [], 0

    def add(self, data: bytes, page_id: int | None, level: int) -> None:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.data.write(packed)
        self.index.append(json.dumps({"page": page_id, "offset": self.bytes, "length": len(packed)}))
        self.bytes += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index)


def revisits(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(sha, first): of payloads of at least ``least`` bytes that more than one row has, the smallest page."""
    payload = F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary")
    hashed = pages.select(col(id_col).cast("long").alias("page"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    return hashed.where(F.col("n") >= least).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sha", "first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write one record per row of ``pages`` and return the manifest (path, records).

    The payload is the text in UTF-8, a null one is empty. Of rows with equal
    payloads of at least ``least`` bytes the smallest page is a response and the
    others revisit it; rows that repeat that page are responses too. A null url
    is left out. An empty table writes nothing.
    """
    again = materialize(revisits(pages, id_col, payload_col, least), "revisits")
    payload = F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).cast("long").alias("page"), col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("s"))
    rows = rows.join(again, F.col("s") == F.col("sha"), "left").select("page", "url", "payload", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for part in slices(batches, 256):
            for page, url, payload, first in zip(*(c.to_pylist() for c in part.columns)):
                writer = writer or _Writer(folder)
                writer.add(record(page, url, payload, first, date), page, level)
                if len(writer.index) >= RECORDS or writer.bytes >= BYTES:
                    path, n = writer.close()
                    yield emit(schema, [path], [n])
                    writer = None
        if writer:
            path, n = writer.close()
            yield emit(schema, [path], [n])

    return materialize(rows.mapInArrow(run, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True, run_length: int = RUN) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record of the archives.

    payload is what the record holds, nothing for a revisit; payload_bytes and
    payload_digest are of the full payload. Without ``payloads`` the column is
    left out.
    """
    kind = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("url", pa.string()), *([("payload", pa.binary())] if payloads else [])]
    schema = pa.schema(kind)
    runs = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("records", F.lit(1)) - 1, F.lit(run_length).cast("long"))).alias("first"))
    # about one run a task: a given number of partitions is not merged, however few bytes the runs' rows have
    dealt = runs.repartition(max(1, runs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            system, path = file_system(part.column(0)[0].as_py())
            with system.open_input_file(path) as file:
                archive = ZipArchive(file, file.size())
                lines = archive.read(INDEX).splitlines()
                entries = [json.loads(x) for x in lines[part.column(1)[0].as_py():][:run_length]]
                rows = []
                for e in entries:
                    found = parse(zlib.decompress(archive.read(DATA, e["offset"], e["length"]), 31))
                    rows.append([found[name] for name in schema.names])
                    if len(rows) == 256:
                        yield emit(schema, *zip(*rows))
                        rows = []
                if rows:
                    yield emit(schema, *zip(*rows))

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return dealt.mapInArrow(run, out)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without the payloads."""
    folder = scratch_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, **how), payloads=False)
