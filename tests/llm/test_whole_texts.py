"""Whole results recomputed without the library: fingerprints and media columns of every row, and texts of millions of characters."""

import hashlib
import math
import random
import struct
import tarfile
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import conform.llm.fingerprints as fp
from public_tokenizers import PATTERN

from conform.llm import bpe_codec, media_columns, token_counts, warc_zip
from conform.llm.common import new_path
from conform.llm.queries import tokenizer_path

LONG = " ".join(random.Random(7).choice(["über", "the", "東京", "x1", "Don't", "...", "\n"]) for _ in range(400_000))


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["Straße  ﬁn", "strasse fin ", "other", None, "", "é" * 2000, "other", "Ünï  COde\t x", LONG, LONG[:-1], "A", "a "]
    data = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "again", ""), (3, "again", ""), (6, "twice", ""), (None, "no id", ""), (None, "None", ""), (None, None, "")]
    return spark.createDataFrame(data, "doc_id long, text string, digest string").repartition(4)


def canonical(text):
    text = unicodedata.normalize("NFKC", text).upper().lower()
    return unicodedata.normalize("NFKC", " ".join(text.split()))


def fingerprint(text):
    raw = canonical(text).encode()
    second = xxhash.xxh64_intdigest(struct.pack("<i", fp.SEED), 42)
    return f"{xxhash.xxh64_intdigest(raw, 42):016x}{xxhash.xxh64_intdigest(raw, second):016x}"


def test_every_fingerprint_column(spark, rows):
    plain = [(r.doc_id, r.t, r.h) for r in rows.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()]
    plain.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    want = []
    for (i, t, _), (_, after, _) in zip(plain, [*plain[1:], plain[0]], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after))))
    assert Counter(tuple(r) for r in fp.fingerprint_likeness(rows).collect()) == Counter(want)


def pixels(stored):
    """The samples of a grey PNG, row by row."""
    assert stored[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed, size = 8, b"", None
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        assert struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
        packed += body if kind == b"IDAT" else b""
        at += n + 12
    raw = zlib.decompress(packed)
    width, height = size
    lines = [raw[y * (width + 1) : (y + 1) * (width + 1)] for y in range(height)]
    assert {line[0] for line in lines} == {0} and len(raw) == height * (width + 1)
    return b"".join(line[1:] for line in lines)


def feature(payload):
    counts, n = Counter(payload), len(payload)
    mean = sum(b * c for b, c in counts.items()) / n
    spread = math.sqrt(sum(c * (b - mean) ** 2 for b, c in counts.items()) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    sixteenths = [sum(counts[b] for b in range(16 * k, 16 * k + 16)) / n for k in range(16)]
    return mean, spread, entropy, [255 * x for x in sixteenths]


def test_every_media_column(spark, rows):
    folder = new_path(spark, "media-test")
    index = media_columns.write_shards(rows, folder)
    assert index.count() == rows.count()
    files = {}
    for path in Path(folder.removeprefix("file://")).glob("*.tar"):
        with tarfile.open(path) as tar:
            for member in tar:
                files[path.name, member.offset_data] = (member.name, tar.extractfile(member).read())
    found = media_columns.read_media(media_columns.read_headers(media_columns.members_of(index), folder), folder).collect()
    texts = {(t or "").encode() for (t,) in rows.select("text").collect()}
    payloads = {hashlib.sha256(p).hexdigest(): p for p in (t + b"\xff" * (576 if not t else -len(t) % 576) for t in texts)}
    assert {r.digest for r in found} == set(payloads) and len(found) == len(payloads)
    for r in found:
        name, stored = files[r.shard, r.offset]
        payload = payloads[r.payload_sha256]
        assert name == f"{r.digest}.png" and pixels(stored) == payload
        assert (r.media_bytes, r.length, r.media_sha256) == (len(stored), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.payload_bytes, r.tail_crc32, r.width, r.height) == (len(payload), zlib.crc32(payload[-32:]), 576, len(payload) // 576)
        parts = dict(x.split("=") for x in r.feature.split(";"))
        mean, spread, entropy, shares = feature(payload)
        assert abs(float(parts["mean"]) - mean) < 6e-4 and abs(float(parts["std"]) - spread) < 6e-4 and abs(float(parts["entropy"]) - entropy) < 6e-5
        assert all(abs(int(parts["hist"][2 * k : 2 * k + 2], 16) - x) <= 0.5 + 1e-9 for k, x in enumerate(shares))


def test_very_long_texts_have_the_librarys_tokens(spark):
    texts = {1: LONG, 2: "ab" * 300_000, 3: " " * 100_000 + "x", 4: "é\n" * 200_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(tokenizer_path())
    counted = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer_path(), PATTERN).collect()}
    coded = {r.doc_id: r for r in bpe_codec.round_trip(docs, tokenizer_path()).collect()}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert counted[i].n_tokens == coded[i].n_tokens == len(ids) and counted[i].n_bytes == len(t.encode()) and counted[i].over_limit == (len(ids) > 1024)
        assert coded[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_very_long_pages_come_back_from_the_archive(spark):
    pages = spark.createDataFrame([(1, "u", LONG), (2, "v", LONG), (3, "w", LONG + "!"), (4, None, None)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc_zip.archive_pages(pages).collect()}
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {1: (len(LONG.encode()), "revisit", 2), 2: (len(LONG.encode()), "response", None), 3: (len(LONG.encode()) + 1, "response", None), 4: (0, "response", None)}
