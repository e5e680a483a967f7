"""WARC records in ZIP-packaged archives, read back by range without extraction.

A task streams its pages into archives: a stored member ``archive/data.warc`` and a stored member ``indexes/index.cdxj`` with
the offset and length of every record. The reader parses the end record, the ZIP64 end record and the central directory,
finds the members' bytes from their local headers, plans byte ranges from the index, and reads records range by range.

Pages with equal payloads of at least ``least`` bytes share one stored payload: the one with the largest ``page_id`` is
the response, the others are revisit records that name it. Archives have names of their own for each attempt and are listed
in a table that Spark commits, so a lost task leaves at most an unlisted file.

Defined cases: a null payload counts as empty; a null ``page_id`` is smaller than any other; rows that tie for the largest
``page_id`` of a payload are all responses; a null url gives no target field; no row gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.llm.common import materialize, new_path, ship

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
#: Bytes of an archive after which the next one is begun; bytes of a range that a reader takes at once.
ARCHIVE_BYTES, RANGE_BYTES = 512 << 20, 4 << 20
#: Groups of equal payloads up to which their table is broadcast (40 bytes each).
FEW_GROUPS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC wants a date; the pages have none, and equal input must give equal archives.
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(kind: str, page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A WARC 1.1 record with the HTTP headers of a response; a revisit leaves the payload out."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    kind: str
    page_id: str | None
    url: str | None
    payload: bytes
    payload_bytes: int
    digest: str
    refers_to: str | None


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    bare = lambda k: (fields[k].removeprefix("<urn:page:").removesuffix(">") or None) if k in fields else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != declared or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return Record(fields["warc-type"], bare("warc-record-id"), fields.get("warc-target-uri"), payload, declared, digest, bare("warc-refers-to"))


class Archive:
    """A ZIP file written front to back."""

    def __init__(self, folder: str) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.zip"
        self.file = store.open_output_stream(f"{root}/{self.name}")
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(self._info(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def add(self, record: bytes, page_id: object) -> None:
        self.data.write(record)
        self.lines.append(json.dumps({"id": page_id, "offset": self.size, "length": len(record)}))
        self.size += len(record)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(self._info(INDEX), "w", force_zip64=True) as out:
            for line in self.lines:
                out.write(line.encode("utf-8") + b"\n")
        self.zip.close()
        self.file.close()
        return self.name, len(self.lines)


class Member(NamedTuple):
    name: str
    header: int
    size: int
    method: int


class ZipDirectory:
    """The central directory of a ZIP file, by range reads; ``file`` has ``size()``, ``seek`` and ``read``."""

    def __init__(self, file) -> None:
        self.file, self.length = file, file.size()
        self.members = {m.name: m for m in self._members()}

    def at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _end(self) -> tuple[int, int, int]:
        """Offset, size and entries of the central directory."""
        start = max(0, self.length - 65_557)
        tail = self.at(start, self.length - start)
        i = tail.rfind(b"PK\x05\x06")
        if i < 0:
            raise ValueError("no end of central directory")
        entries, size, offset = struct.unpack("<HII", tail[i + 10 : i + 20])
        if entries != 0xFFFF and 0xFFFFFFFF not in (size, offset):
            return offset, size, entries
        place = self.at(start + i - 20, 20)
        if place[:4] != b"PK\x06\x07":
            return offset, size, entries  # exactly that many, without ZIP64
        end = self.at(struct.unpack("<Q", place[8:16])[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, size, offset = struct.unpack("<QQQ", end[32:56])
        return offset, size, entries

    def _members(self) -> Iterator[Member]:
        offset, size, entries = self._end()
        raw, at = self.at(offset, size), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method, packed, plain = struct.unpack("<H", raw[at + 10 : at + 12])[0], *struct.unpack("<II", raw[at + 20 : at + 28])
            name_n, extra_n, note_n = struct.unpack("<HHH", raw[at + 28 : at + 34])
            (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
            name = raw[at + 46 : at + 46 + name_n].decode("utf-8")
            extra, i = raw[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while i + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[i : i + 4])
                if kind == 1:  # ZIP64: the values that do not fit, in this order
                    j = i + 4
                    if plain == 0xFFFFFFFF:
                        (plain,), j = struct.unpack("<Q", extra[j : j + 8]), j + 8
                    if packed == 0xFFFFFFFF:
                        (packed,), j = struct.unpack("<Q", extra[j : j + 8]), j + 8
                    if header == 0xFFFFFFFF:
                        (header,) = struct.unpack("<Q", extra[j : j + 8])
                i += 4 + n
            yield Member(name, header, packed, method)
            at += 46 + name_n + extra_n + note_n

    def range_of(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.at(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        name_n, extra_n = struct.unpack("<HH", head[26:30])
        return m.header + 30 + name_n + extra_n, m.size


def with_responses(pages: DataFrame, least: int = 0, payload: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, payload binary, kind, refers_to``: which record of each payload keeps it."""
    raw = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload")).withColumn("__sha1", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= least
    groups = rows.filter(long_enough).groupBy("__sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("__keeper")).filter("n > 1").drop("n")
    groups = materialize(groups, "warc-groups")
    few = groups.count() <= FEW_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, "__sha1", "left")
    revisit = F.col("__keeper").isNotNull() & long_enough & ~F.col("page_id").eqNullSafe(F.col("__keeper"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("__keeper")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of :func:`with_responses`; a committed table ``archive, records``."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, payload, kind, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "kind", "refers_to")), strict=True):
                if archive is not None and archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
                archive = archive or Archive(folder)
                archive.add(record_bytes(kind.as_py(), page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()), page_id.as_py())
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return materialize(records.select("page_id", "url", "payload", "kind", "refers_to").mapInArrow(run, "archive string, records long"), "warc-archives")


def plan_ranges(archives: DataFrame, folder: str) -> DataFrame:
    """``archive, offset, lengths``: runs of records of about RANGE_BYTES, found through directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    zipped = ZipDirectory(file)
                    base, _ = zipped.range_of(DATA)
                    at, size = zipped.range_of(INDEX)
                    found = [json.loads(x) for x in zipped.at(at, size).splitlines()]
                runs, lengths, start = [], [], 0
                for x in found:
                    if lengths and x["offset"] + x["length"] - start > RANGE_BYTES:
                        runs.append((start, lengths))
                        lengths = []
                    if not lengths:
                        start = x["offset"]
                    lengths.append(x["length"])
                runs += [(start, lengths)] if lengths else []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(runs), pa.string()), pa.array([base + s for s, _ in runs], pa.int64()), pa.array([n for _, n in runs], pa.list_(pa.int64()))], ["archive", "offset", "lengths"])

    return archives.select("archive").mapInArrow(run, "archive string, offset long, lengths array<long>")


def read_ranges(ranges: DataFrame, folder: str, id_type: str = "bigint", content: bool = False) -> DataFrame:
    """The records of the planned ranges; with ``content`` their payloads too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, offset, lengths in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "lengths")), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    file.seek(offset)
                    raw = file.read(sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(raw[at : at + n]))
                    at += n
                names = ["page_id", "payload_bytes", "digest", "kind", "refers_to", "url"]
                columns = [pa.array([getattr(r, c) for r in rows], pa.int64() if c == "payload_bytes" else pa.string()) for c in names]
                columns += [pa.array([r.payload for r in rows], pa.binary())] if content else []
                yield pa.RecordBatch.from_arrays(columns, [*names, *["payload"] * content])

    read = ranges.mapInArrow(run, "page_id string, payload_bytes long, digest string, kind string, refers_to string, url string" + ", payload binary" * content)
    return read.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(id_type).alias("refers_to"), "url", *["payload"] * content)


def read_archives(archives: DataFrame, folder: str, id_type: str = "bigint", content: bool = False) -> DataFrame:
    return read_ranges(plan_ranges(archives, folder).repartition("archive", "offset"), folder, id_type, content)


def archive_pages(pages: DataFrame, least: int = 0, payload: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Write the pages to archives in the shared folder and read every record back."""
    folder = new_path(pages.sparkSession, "warc")
    archives = write_archives(with_responses(pages, least, payload, id_col, url), folder)
    return read_archives(archives, folder, pages.schema[id_col].dataType.simpleString())


#: The rows of :func:`archive_pages` from the pages alone, for DuckDB. Five hexadecimal digits make four of base 32.
SQL = """
WITH read AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, url, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex FROM read),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT), lambda v:
    array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to, url
FROM kept
"""
