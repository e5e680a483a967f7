"""Media columns: content-addressed payloads in tar shards, read back by range.

Every text becomes a payload of 8-bit samples, stored without loss as a grey PNG of 576 samples a row. A task writes its payloads as
members of tar shards in the shared folder; members are named by the digest of the payload, and equal payloads of
a shard are stored once. Of members that several tasks stored, the index keeps one, so rows with equal payloads carry the same shard, digest,
offset and length. Range reads of the members' headers fill the metadata columns; whole members are read for digests and features, each once,
in the order of the shards, in as many tasks as their bytes ask for.

Shards are written under a name of their own for each attempt and listed in a table that Spark commits, so a lost or
repeated task leaves at most an unlisted file. Defined cases: a null or empty text becomes one row of bytes 255; a null
``doc_id`` stays null; repeated rows give repeated rows that share a member; no row gives no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.llm.common import materialize, new_path, ship

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a shard after which the next one is begun.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
#: Bytes of members that a task reads back, about.
TASK_BYTES = 16 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * (UNIT - len(raw) if not raw else -len(raw) % UNIT), len(raw)


def png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8 bits a sample, UNIT samples a row, no row filter."""
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, UNIT)
    return SIGNATURE + png_chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + png_chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(stored: bytes) -> bytes:
    width, height, _ = png_header(stored)
    at, packed = 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            packed.append(stored[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, and the share of each sixteenth of the range in 1/255."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float((p * np.arange(256)).sum())
    spread = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    q = p[p > 0]
    sixteen = "".join(f"{int(round(255 * x)):02x}" for x in p.reshape(16, 16).sum(axis=1))
    return f"mean={mean:.3f};std={spread:.3f};entropy={float(-(q * np.log2(q)).sum()):.4f};hist={sixteen}"


def tar_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.GNU_FORMAT)


class Shard:
    """A tar file that is written front to back; ``put`` gives the offset of a member's bytes."""

    def __init__(self, folder: str) -> None:
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}.tar"
        self.name = os.path.basename(self.path)
        self.out = self.store.open_output_stream(self.path)
        self.size = 0
        self.known: dict[bytes, tuple[int, int]] = {}

    def put(self, digest: bytes, make) -> tuple[int, int]:
        if digest not in self.known:
            stored = make()
            self.out.write(tar_header(f"{digest.hex()}.png", len(stored)))
            self.out.write(stored)
            self.out.write(b"\0" * (-len(stored) % 512))
            self.known[digest] = self.size + 512, len(stored)
            self.size += 512 + len(stored) + -len(stored) % 512
        return self.known[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def write_shards(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store every text; a committed table ``doc_id, n_bytes, shard, digest, offset, length``, in the order of the shards. No shuffle."""
    ship(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for value in batch.column(1):
                payload, n = payload_of(value.as_py())
                if shard is None or shard.size >= SHARD_BYTES:
                    if shard is not None:
                        shard.close()
                    shard = Shard(folder)
                digest = hashlib.sha256(payload).digest()
                rows.append((n, shard.name, digest.hex(), *shard.put(digest, lambda p=payload: to_png(p))))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "n_bytes", "shard", "digest", "offset", "length"])
        if shard is not None:
            shard.close()

    kind = source.schema["doc_id"].dataType.simpleString()
    return materialize(source.mapInArrow(run, f"doc_id {kind}, n_bytes long, shard string, digest string, offset long, length long"), "media-index")


class Ranges:
    """Range reads, with the last shard kept open."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.root}/{shard}")
        self.file.seek(offset)
        got = self.file.read(length)
        if len(got) != length:
            raise OSError(f"{shard}: {len(got)} of {length} bytes at {offset}")
        return got


def members_of(index: DataFrame) -> DataFrame:
    """One member for each digest, ``digest, shard, offset, length``, dealt out in the order of the shards."""
    one = F.min(F.struct("shard", "offset", "length"))
    members = materialize(index.groupBy("digest").agg(one.alias("m")).select("digest", "m.shard", "m.offset", "m.length"), "media-members")
    tasks = max(1, -(-(members.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    return members.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def read_headers(members: DataFrame, folder: str) -> DataFrame:
    """The members with ``width, height, bits``, from the first HEADER_BYTES bytes of each."""
    ship(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        for batch in batches:
            found = [png_header(ranges.read(s, o, HEADER_BYTES)) for s, o in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True)]
            extra = [pa.array([x[i] for x in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "width", "height", "bits"])

    return members.mapInArrow(run, f"{_ddl(members)}, width int, height int, bits int")


def read_media(members: DataFrame, folder: str) -> DataFrame:
    """Whole members read back: the members with digests, checksums and features of payload and stored form; a member that does not match its digest is an error."""
    ship(members.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        for batch in batches:
            rows = []
            for shard, digest, offset, length in zip(*(batch[c].to_pylist() for c in ("shard", "digest", "offset", "length")), strict=True):
                stored = ranges.read(shard, offset, length)
                payload = from_png(stored)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise OSError(f"{shard}: the member at {offset} is not {digest}")
                rows.append((len(payload), digest, zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])

    return members.mapInArrow(run, f"{_ddl(members)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the shards to the shared folder, read headers and then whole members back, and join what was found to the rows by digest."""
    folder = new_path(docs.sparkSession, "media-shards")
    folder = folder if "://" in folder or folder.startswith("/") else os.path.abspath(folder)
    index = write_shards(docs, folder, text, id_col)
    media = materialize(read_media(read_headers(members_of(index), folder), folder), "media-columns")
    return index.select("doc_id", "n_bytes", "digest").join(media, "digest")
