"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a doubly linked list of byte symbols. A heap holds the rank of every adjacent pair; the lowest
rank (the leftmost of equals) is popped and merged until none is left. The count is the number of initial symbols
less the number of merges: no identifier is ever produced. Counts of pre-tokens are kept per worker in a bounded
memory, since most pre-tokens repeat.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null ``doc_id`` stays null; repeated rows give
repeated results; no row gives no row; other columns are ignored, whatever their names. A text of any length is
counted whole; special strings inside it count as one token each, as the tokenizers library does by default.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from conform.llm.common import ship

#: Pre-tokens whose count a worker remembers at most.
REMEMBERED = 400_000
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairRanks:
    """Merge ranks over byte strings, read from a byte-level BPE file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault((raw(left), raw(right)), rank)
        self.split = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def merged_length(self, piece: bytes) -> int:
        """Tokens of one pre-token: initial symbols minus merges."""
        n = len(piece)
        symbol = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        ranks = self.ranks
        heap = []
        for i in range(n - 1):
            rank = ranks.get((symbol[i], symbol[i + 1]))
            if rank is not None:
                heap.append((rank, i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbol[i] != left or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            symbol[i] = left + right
            alive[j] = False
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (rank := ranks.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (rank, i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (rank, h, symbol[h], symbol[i]))
        return n - merges

    def count_plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.split.findall(text):
            n = known.get(piece)
            if n is None:
                n = self.merged_length(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.count_plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.count_plain(text[at:])


@lru_cache(maxsize=2)
def pair_ranks(path: str, pattern: str) -> PairRanks:
    return PairRanks(path, pattern)


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 1024, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``. No shuffle."""
    ship(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pair_ranks(tokenizer, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [bpe.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
