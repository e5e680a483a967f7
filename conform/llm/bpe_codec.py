"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks whose borders depend on the neighbouring bytes only, so a
passage that several documents share gives the same chunks wherever it stands. A worker encodes a chunk once for as long as
it remembers it; what was not used for longest is forgotten first. A cut may fall inside a token, so the ends of a chunk cannot be trusted: a
chunk's own identifiers are used between its first and last *safe* points (a space after a character that is no white
space; byte-level pre-tokens never reach across one), and each join is repaired by encoding again the stretch between the
neighbouring safe points. The stretch grows over as many chunks as it takes until both its ends are safe. That the joins are right is not
taken for granted: at each the words on both sides are encoded together, and their identifiers compared with those that the two pieces
have there. Where they differ the pieces become one, which is encoded again, until all joins agree exactly.

What is new in a chunk is cut into pre-tokens; those that a worker remembers cost a look-up, the others go through the tokenizer.
Identifiers are decoded by a table of the bytes of every token.

Defined cases: a null or empty text has 0 identifiers and decodes to the empty text; special strings inside a text are their own
identifiers, as the tokenizers library does by default; a null ``doc_id`` stays null;
repeated rows give repeated results; no row gives no row; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from conform.llm.common import ship, tidy
from conform.llm.token_counts import byte_alphabet

#: Bytes that the rolling hash sees, and the mask that a border's hash must meet: a chunk has about 2 ** 9 bytes.
WINDOW, MASK = 16, (1 << 9) - 1
#: Characters of pieces, and of pre-tokens, that a worker remembers at most.
PIECE_CHARS, WORD_CHARS = 8 << 20, 3 << 20
#: Characters of a pre-token beyond which it is not remembered, and pre-tokens encoded in one call.
LONG_WORD, TOGETHER = 64, 4096
SAFE = regex.compile(r"(?<=\S) ")
#: The same, searched from the end.
LAST_SAFE = regex.compile(r"(?r)(?<=\S) ")
_POWERS = np.array([pow(0x9E3779B1, WINDOW - 1 - i, 1 << 32) for i in range(WINDOW)], dtype=np.uint32)


def borders(raw: bytes) -> np.ndarray:
    """Byte offsets at which a chunk starts, 0 excluded: where the hash of the last WINDOW bytes meets the mask."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    rolled = np.zeros(len(data) - WINDOW, dtype=np.uint32)
    for i in range(WINDOW):
        rolled += data[i : len(data) - WINDOW + i].astype(np.uint32) * _POWERS[i]
    cut = np.flatnonzero(((rolled >> 11) & MASK) == MASK) + WINDOW
    return cut[(data[cut] & 0xC0) != 0x80]  # never inside a character


def chunks(text: str) -> list[str]:
    raw = text.encode("utf-8")
    at = [0, *borders(raw).tolist(), len(raw)]
    return [raw[a:b].decode("utf-8") for a, b in zip(at, at[1:], strict=False) if a < b]


def pieces(parts: list[str]) -> list[str]:
    """What is encoded for a list of chunks: safe middles of chunks and the repaired stretches between them."""
    out, open_ = [], ""
    for part in parts:
        first = SAFE.search(part)
        if first is None:
            open_ += part
            continue
        last = LAST_SAFE.search(part).start()
        out.append(open_ + part[: first.start()])
        if last > first.start():
            out.append(part[first.start() : last])
        open_ = part[last:]
    out.append(open_)
    return [x for x in out if x]


def ends_of(piece: str) -> tuple[str, str]:
    """What stands before a piece's first inner safe point, and what after its last; the piece itself if it has none."""
    first, last = SAFE.search(piece, 1), LAST_SAFE.search(piece, 1)
    return (piece[: first.start()], piece[last.start() :]) if first else (piece, piece)


class Memory:
    """Strings and their identifiers in two generations: a hit in the old one moves to the young one, and when the
    young one is full it becomes the old one, so what has long not been used goes first."""

    def __init__(self, most: int) -> None:
        self.most, self.size = most // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        self.size += len(key)
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, len(key)
        self.young[key] = value


class ChunkCodec:
    """Encodes with bounded memories of pieces of chunks and of pre-tokens. Identifiers are bytes: 32 bits each, little-endian."""

    def __init__(self, path: str, pattern: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(pattern)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special strings that take in their surroundings are not supported")
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
        back, vocabulary = byte_alphabet(), self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode("utf-8")
        self.own = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.pieces, self.words = Memory(PIECE_CHARS), Memory(WORD_CHARS)

    def encode_new(self, texts: list[str]) -> list[bytes]:
        """Encode strings by their pre-tokens."""
        cut = [self.split.findall(x) for x in texts]
        distinct: set[str] = set()
        for words in cut:
            distinct.update(words)
        get = self.words.get
        found = {w: get(w) for w in distinct}
        new = [w for w, ids in found.items() if ids is None]
        for i in range(0, len(new), TOGETHER):
            group = new[i : i + TOGETHER]
            for w, e in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
                ids = found[w] = array("I", e.ids).tobytes()
                if len(w) <= LONG_WORD:
                    self.words.put(w, ids)
        return [b"".join(map(found.__getitem__, words)) for words in cut]

    def _add(self, new: dict[str, bytes], wanted: Iterable[str]) -> None:
        """Put the identifiers of all wanted strings into ``new``, encoding those that are not remembered."""
        fresh = []
        for x in wanted:
            if x not in new:
                new[x] = found = self.pieces.get(x)
                if found is None:
                    fresh.append(x)
        for x, ids in zip(fresh, self.encode_new(fresh), strict=True):
            new[x] = ids
            self.pieces.put(x, ids)

    def _agreed(self, plans: list[list[str]], new: dict[str, bytes]) -> tuple[list[list[str]], bool]:
        """Compare both sides of every join; pieces whose join does not agree become one."""
        ends = {x: ends_of(x) for x in {x for plan in plans if len(plan) > 1 for x in plan}}
        joins = {(ends[a][1], ends[b][0]) for plan in plans for a, b in zip(plan, plan[1:], strict=False)}
        sides = list({x for pair in ends.values() for x in pair} | {a + b for a, b in joins})
        side = dict(zip(sides, self.encode_new(sides), strict=True))
        same = {(a, b): side[a + b] == side[a] + side[b] for a, b in joins}
        out, changed = [], False
        for plan in plans:
            merged = plan[:1]
            for a, b in zip(plan, plan[1:], strict=False):
                tail, head = ends[a][1], ends[b][0]
                if same[tail, head] and new[a].endswith(side[tail]) and new[b].startswith(side[head]):
                    merged.append(b)
                else:
                    merged[-1] += b
                    changed = True
            out.append(merged)
        return out, changed

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """The identifiers of texts without special strings."""
        plans = [pieces(chunks(x)) for x in texts]
        new: dict[str, bytes] = {}
        changed = True
        while changed:
            self._add(new, (x for plan in plans for x in plan))
            plans, changed = self._agreed(plans, new)
        return [b"".join(map(new.__getitem__, plan)) for plan in plans]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.special is None:
            return self.encode_plain(texts)
        parts = [self.special.split(x) for x in texts]  # every second part is a special string
        plain = iter(self.encode_plain([x for some in parts for x in some[::2]]))
        return [b"".join(self.own[x] if i % 2 else next(plain) for i, x in enumerate(some)) for some in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ChunkCodec:
    return ChunkCodec(path, pattern)


def groups_of(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters: what is in memory at once follows these, not the batch."""
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, tokenizer: str, pattern: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The identifiers of every text: ``doc_id, ids array<long>, decoded string``. No shuffle. ``pattern`` cuts pre-tokens; by default that of byte-level tokenizers."""
    form = lambda ids, back: (pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(back, pa.string()))
    return _run(docs, tokenizer, pattern, text, id_col, "ids array<long>, decoded string", form, ["ids", "decoded"])


def round_trip(docs: DataFrame, tokenizer: str, pattern: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digests of the identifiers and of the decoded text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. No shuffle."""

    def digests(ids: list[bytes], back: list[str]) -> tuple[pa.Array, ...]:
        return (
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back], pa.string()),
        )

    return _run(docs, tokenizer, pattern, text, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs: DataFrame, tokenizer: str, pattern: str | None, text: str, id_col: str, schema: str, form, names: list[str]) -> DataFrame:
    ship(docs.sparkSession)
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    source = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in batches:
            at = 0
            for group in groups_of([x or "" for x in batch.column(1).to_pylist()]):
                ids = own.encode(group)
                columns = form(ids, [own.decode(x) for x in ids])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), *columns], ["doc_id", *names])
                at += len(group)
        tidy()

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {schema}")
