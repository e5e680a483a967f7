"""Removal of passages that occur more than once, byte by byte, with a run-length index of the corpus.

Every string of ``LENGTH`` bytes that starts at two places has to be found, so an index of one block of the corpus would have to meet all others. Instead
strings meet by an anchor: of the 64-byte grams inside a string the one with the least hash (the first of equals). Equal strings have equal anchors at equal
offsets, so a document falls into pieces, the longest runs of strings with one anchor, and only pieces with the same anchor can hold equal strings.
Pieces whose anchor stands once in the corpus are done. The others are dealt by anchor into blocks of bounded size, and each block gets an index:

* Its text are the distinct pieces, each with a separator of its own and with the number of its copies. Suffixes are sorted by prefix doubling; the symbols
  before them are the Burrows-Wheeler transform, kept as runs. Copies of a piece would only lengthen runs, so their number is kept beside it.
* Of each run the suffixes at both ends are sampled, with the length that they share with the suffix beyond the run's end. Inside a run
  the symbols before two neighbours agree, so the shared length falls by one from one text position to the next; the samples therefore give it everywhere.
* Matching statistics are streamed from the samples: for every position the longest string that starts there and elsewhere too. Where they reach ``LENGTH`` the
  string is a repeat; a piece with copies repeats as a whole.

An anchor with more than ``MOST_PIECES`` different pieces (the ends of a passage that very many documents share) is split exactly: its strings become
pieces of their own, with their own hash as the anchor, so that no task gets an unbounded group. Copies are counted before they are shuffled.

Defined cases: a null text counts as empty; texts shorter than ``LENGTH`` keep all; texts of any length are read whole; rows without or with repeated ids are
documents of their own; equal rows remove each other, since both strings stand elsewhere; no row gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.llm.common import materialize, new_path, ship, text_of, tidy

#: Bytes of a string that counts when it repeats, and of the grams of which one is its anchor.
LENGTH, GRAM = 400, 64
#: Grams in a string.
SPAN = LENGTH - GRAM + 1
#: Bytes looked at together when anchors are chosen; longer texts are read in such parts, which overlap by a string.
PART = 1 << 20
#: Bytes of an index, about, of a task that builds indexes, and of a task of texts.
BLOCK, TASK, BUCKET = 2 << 20, 12 << 20, 24 << 20
#: Different pieces of one anchor that one index takes; an anchor with more is split into its strings.
MOST_PIECES = 2048
#: Rows of one piece from which its marks are broadcast; about ``total / HOT_ROWS`` pieces can have so many, and the number rises until at most ``MOST_HOT`` have.
HOT_ROWS, MOST_HOT = 20_000, 100_000
_PIECE = "rid bigint, start bigint, windows int, anchor bigint, h1 bigint, h2 bigint"
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -- pieces ----------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place on: strings of 1, 2, 4 ... bytes are put together from their halves."""
    h, factor, size = _TABLE[data], np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            factor, size = factor * factor, 2 * size
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray) -> np.ndarray:
    """For each string of ``LENGTH`` bytes the place of its gram with the least hash, the first of equals; strings that share bytes are looked at together."""
    h = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    h &= ~low
    h |= np.arange(len(h), dtype=np.uint64)
    n = len(h) - SPAN + 1
    padded = np.full(-(-len(h) // SPAN) * SPAN, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & low).astype(np.int64)


def _digests(parts: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in parts]), np.int64).reshape(-1, 2)


def _pieces(texts: Iterator[tuple[int, int, memoryview]]) -> pa.RecordBatch:
    """Pieces of parts of texts: (row, place in the text, bytes), together about ``PART`` bytes."""
    rids, offsets, raw = zip(*texts)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - [len(r) for r in raw]
    at = anchors(data)
    edge = np.zeros(len(at) + 1, bool)
    edge[1:-1] = at[1:] != at[:-1]
    inside = np.zeros(len(at) + 1, np.int8)  # strings that lie in one text
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(ends - LENGTH + 1, len(at)), -1)
    inside = np.cumsum(inside[:-1], dtype=np.int64) > 0
    edge[starts] = True
    edge[np.minimum(ends - LENGTH + 1, len(at))] = True
    first = np.flatnonzero(edge[:-1])
    last = np.append(first[1:], len(at))
    keep = inside[first]
    first, last = first[keep], last[keep]
    which = np.searchsorted(ends, first, side="right")
    whole = memoryview(data)
    hashes = _digests([whole[a : b + LENGTH - 1] for a, b in zip(first.tolist(), last.tolist())])
    grams = gram_hashes(data).view(np.int64)[at[first]]
    columns = [np.array(rids, np.int64)[which], first - starts[which] + np.array(offsets, np.int64)[which], (last - first).astype(np.int32), grams, hashes[:, 0], hashes[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _PIECE.split(", ")])


def find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rid, data`` to pieces."""
    held: list[tuple[int, int, memoryview]] = []
    size = 0
    for batch in batches:
        for rid, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = memoryview(value.as_buffer())
            for start in range(0, max(len(text) - LENGTH + 1, 0), PART):
                held.append((rid, start, text[start : start + PART + LENGTH - 1]))
                size += len(held[-1][2])
                if size >= PART:
                    yield _pieces(iter(held))
                    held, size = [], 0
    if held:
        yield _pieces(iter(held))
    tidy()


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple[memoryview, list[dict]]]:
    """``..., data, wanted``: a text and the list of what is wanted of it."""
    yield from zip((memoryview(v.as_buffer()) for v in batch.column("data")), batch.column("wanted").to_pylist())


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that are wanted of each text."""
    names = ["anchor", "h1", "h2", "copies"]
    for batch in batches:
        found = [(*(w[c] for c in names), text[w["start"] : w["start"] + w["windows"] + LENGTH - 1].tobytes()) for text, wanted in _wanted(batch) for w in wanted]
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], names=[*names, "bytes"])


def split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the pieces that are wanted of each text as a piece of its own, its hash as the anchor."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    for batch in batches:
        for rid, (text, wanted) in zip(batch.column("rid").to_pylist(), _wanted(batch)):
            places = [w["start"] + i for w in wanted for i in range(w["windows"])]
            hashes = _digests([text[p : p + LENGTH] for p in places])
            columns = [np.full(len(places), rid), np.array(places, np.int64), np.ones(len(places), np.int32), hashes[:, 0], hashes[:, 0], hashes[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


# -- index -----------------------------------------------------------------


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. ``left``: bytes before the next separator; separators differ and stand before all bytes, by place."""
    n = len(text)
    symbols = np.zeros(n + 8, np.uint64)
    symbols[:n] = np.where(left > 0, text.astype(np.uint64) + np.uint64(1), np.uint64(0))
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | symbols[i : n + i]
    short = left < 7
    cut = (np.uint64(9) * (np.uint64(7) - np.minimum(left, 7).astype(np.uint64)))
    key = (key >> cut) << cut
    order = np.argsort(key)
    ends = np.flatnonzero(short[order])
    sub = order[ends]
    order[ends] = sub[np.lexsort((sub, key[sub]))]
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | short[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of several
    depth = 7
    while len(slots):
        p = order[slots]
        both = rank[p] * (n + 1) + rank[p + depth]
        by = np.argsort(both)
        p, both = p[by], both[by]
        order[slots] = p
        new = np.ones(len(p), bool)
        new[1:] = both[1:] != both[:-1]
        rank[p] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number, the first byte highest."""
    w, size = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64), 1
    while size < 8:
        w = (w[:-size] << np.uint64(8 * size)) | w[size:]
        size *= 2
    return w


def shared_length(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the strings from ``a`` and from ``b`` on share, ``most`` at most."""
    out, active, depth = most.copy(), np.arange(len(a)), 0
    while len(active):
        x = words[np.minimum(a[active] + depth, len(words) - 1)] ^ words[np.minimum(b[active] + depth, len(words) - 1)]
        differ = x != 0
        at = active[differ]
        zeros = np.zeros(len(at), np.int64)
        for shift in range(8, 64, 8):
            zeros += (x[differ] >> np.uint64(64 - shift)) == 0
        out[at] = np.minimum(depth + zeros, most[at])
        depth += 8
        active = active[~differ]
        active = active[most[active] > depth]
    return out


class RunIndex:
    """A run-length Burrows-Wheeler transform of distinct pieces with the numbers of their copies, sampled at the ends of its runs."""

    def __init__(self, pieces: Sequence[bytes], copies: np.ndarray) -> None:
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(lengths + 1) - 1  # of the separators
        text = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        self.n = len(text)
        self.left = np.repeat(self.ends, lengths + 1) - np.arange(self.n)
        self.copies = np.repeat(copies, lengths + 1)
        order = suffix_array(text, self.left)
        before = np.where((order > 0) & (self.left[order - 1] > 0), text[order - 1].astype(np.int64), -1 - order)  # every separator is a symbol of its own
        heads = np.ones(self.n, bool)
        heads[1:] = before[1:] != before[:-1]
        starts = np.flatnonzero(heads)
        #: The transform: a symbol and a length for each run.
        self.symbols, self.lengths = before[starts], np.diff(np.append(starts, self.n))
        words = _words(text)

        def sample(at: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            here, there = order[at], order[beside]
            shared = shared_length(words, here, there, np.minimum(self.left[here], self.left[there]))
            by = np.argsort(here)
            return here[by], shared[by]

        #: Suffixes at the first and last places of runs, by place in the text, and what they share with the suffix beyond.
        self.first = sample(starts[1:], starts[1:] - 1)
        self.last = sample(starts[1:] - 1, starts[1:])

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of the longest string that starts there and elsewhere: streamed from the samples, one less with each step; a piece with copies matches to its end."""
        out = np.where(self.copies > 1, self.left, 0)
        for places, shared in (self.first, self.last):
            value = np.zeros(self.n, np.int64)
            value[places] = shared + places
            known = np.zeros(self.n, np.int64)
            known[places] = places + 1
            known = np.maximum.accumulate(known)
            found = np.where(known > 0, value[known - 1] - np.arange(self.n), 0)
            out = np.maximum(out, np.minimum(found, self.left))
        return out


def repeats(pieces: Sequence[bytes], copies: np.ndarray) -> list[list[int]]:
    """For each piece the strings that repeat, as first and last places of runs of them: ``[first, last, first, last, ...]``."""
    index = RunIndex(pieces, copies)
    hit = index.matching_statistics() >= LENGTH
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2] - 1
    which = np.searchsorted(index.ends, first)
    out: list[list[int]] = [[] for _ in pieces]
    begin = np.append(0, index.ends[:-1] + 1)
    for k, a, b in zip(which.tolist(), (first - begin[which]).tolist(), (last - begin[which]).tolist()):
        out[k] += [a, b]
    return out


def index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their anchors to marks: an index for each block of whole anchors."""

    def finish(held: list[tuple]) -> pa.RecordBatch:
        _, h1, h2, copies, pieces = zip(*held)
        marks = repeats(pieces, np.array(copies, np.int64))
        rows = [(a, b, c, m) for a, b, c, m in zip(h1, h2, copies, marks) if m]
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int32()))], names=["h1", "h2", "copies", "marks"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield finish(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield finish(held)
    tidy()


# -- results ---------------------------------------------------------------


def covered(marks: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes that strings from first to last places cover, merged where they touch: begins and ends."""
    spans = np.array(marks, np.int64).reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    begin, end = spans[:, 0], np.maximum.accumulate(spans[:, 1] + LENGTH)
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], np.append(end[:-1][new[1:]], end[-1])


def write_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, data, marks`` to results."""
    for batch in batches:
        rows = []
        for value, marks in zip(batch.column("data"), batch.column("marks").to_pylist()):
            text = memoryview(value.as_buffer())
            kept, removed, spans, at = hashlib.sha256(), 0, 0, 0
            if marks:
                for a, b in zip(*(x.tolist() for x in covered(marks))):
                    kept.update(text[at:a])
                    removed, spans, at = removed + b - a, spans + 1, b
            kept.update(text[at:])
            rows.append((len(text), removed, spans, kept.hexdigest()))
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _of_texts(texts: DataFrame, pieces: DataFrame, parts: int, columns: Sequence[str], name: str) -> DataFrame:
    """Texts with what belongs to each: the texts lie in buckets of their row, so only the small side is shuffled."""
    small = pieces.repartition(parts, "rid").groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias(name))
    return texts.join(small.hint("shuffle_hash"), "rid")


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document without the bytes of strings that occur elsewhere too."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_of(text), "UTF-8").alias("data"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(1, -(-total // BUCKET))
    name = f"suffix_dedup_{uuid.uuid4().hex}"
    numbered = rows.withColumn("rid", F.monotonically_increasing_id()).repartition(parts, "rid")
    numbered.write.format("parquet").option("path", new_path(spark, "repeat-texts")).option("compression", "zstd").bucketBy(parts, "rid").saveAsTable(name)
    texts = spark.table(name)
    try:
        pieces = materialize(texts.select("rid", "data").mapInArrow(find_pieces, _PIECE), "repeat-pieces")
        pieces, several = _split_hot(pieces, texts, parts)
        marks = _marks(pieces, several, texts, parts)
        spans = _spans_of(pieces, marks)
        both = texts.join(spans.repartition(parts, "rid").groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("marks")).hint("shuffle_hash"), "rid", "left")
        schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        return materialize(both.select("doc_id", "data", "marks").mapInArrow(write_kept, schema), "repeat-results")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _distinct(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces with their copies and one of their places, and anchors that stand more than once with the number of their distinct pieces."""
    distinct = pieces.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "start", "windows")).alias("at"))
    distinct = materialize(distinct, "repeat-distinct")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.sum("copies").alias("all")).filter("all > 1").select("anchor", "different")
    return distinct, materialize(several, "repeat-anchors")


def _split_hot(pieces: DataFrame, texts: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Pieces in which anchors with too many different pieces are split into strings, and what :func:`_distinct` gives, joined: the distinct pieces that others may match."""
    distinct, several = _distinct(pieces)
    hot = several.filter(F.col("different") > MOST_PIECES).select("anchor")
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= MOST_HOT else hot
        strings = _of_texts(texts, pieces.join(hot, "anchor", "left_semi"), parts, ["start", "windows"], "wanted").select("rid", "data", "wanted").mapInArrow(split_pieces, _PIECE)
        pieces = materialize(pieces.join(hot, "anchor", "left_anti").unionByName(strings), "repeat-split")
        distinct, several = _distinct(pieces)
    return pieces, distinct.join(several.select("anchor"), "anchor", "left_semi")


def _marks(pieces: DataFrame, candidates: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """``h1, h2, copies, marks`` of distinct pieces with repeated strings, by an index of each block of anchors."""
    flat = materialize(candidates.select("at.*", "anchor", "h1", "h2", "copies"), "repeat-candidates")
    size = flat.agg(F.sum(F.col("windows") + LENGTH)).first()[0] or 0
    cut = _of_texts(texts, flat, parts, ["start", "windows", "anchor", "h1", "h2", "copies"], "wanted").select("data", "wanted")
    cut = cut.mapInArrow(cut_pieces, "anchor bigint, h1 bigint, h2 bigint, copies bigint, bytes binary")
    dealt = cut.repartition(max(1, -(-size // TASK)), "anchor").sortWithinPartitions("anchor")
    return materialize(dealt.mapInArrow(index_blocks, "h1 bigint, h2 bigint, copies bigint, marks array<int>"), "repeat-marks")


def _spans_of(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    """``rid, spans``: the marks at the places of all copies. Marks of pieces with very many copies are broadcast, so no key is hot in the join."""
    most = HOT_ROWS
    while (n_hot := marks.filter(F.col("copies") >= most).count()) > MOST_HOT:
        most *= 4
    places = pieces.select("rid", "start", "h1", "h2")
    spans = F.transform("marks", lambda m: m + F.col("start"))
    out = places
    if n_hot:
        hot = F.broadcast(marks.filter(F.col("copies") >= most).select("h1", "h2", "marks"))
        frequent = places.join(hot, ["h1", "h2"]).select("rid", spans.alias("spans"))
        out = places.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti")
    rare = out.join(marks.filter(F.col("copies") < most).select("h1", "h2", "marks"), ["h1", "h2"]).select("rid", spans.alias("spans"))
    return rare.unionByName(frequent) if n_hot else rare
