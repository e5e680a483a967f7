"""A gated recurrent language model in numpy, trained and applied by Spark.

*Words.* ASCII capitals are lower-cased; a text is its words and then one end. Words of all training texts are counted in each task first (at most
``COUNTED`` at a time), then by a Spark aggregation. Words with the highest counts (at most ``HEAD_WORDS``, 64 bytes each) are broadcast; all other
words are joined, where adaptive execution splits a word that fills a partition.

*Model.* A GRU reads symbols; its output softmax is factored: a class of ``CLASS_WORDS`` symbols from the state, then, again from the state, a
symbol of the class. The ``NET_WORDS`` most frequent words are symbols by falling count.
Another ``SHAPES`` symbols stand for all other words: a word's shape is found from its last two bytes before closing punctuation, which tell the
language well, and the words of a shape share its probability by their discounted counts. What the discount leaves is the share of the shape's words never seen. It is spread evenly over as many words as the class is
expected to hold unseen (Chao's estimate from its words seen once and twice, at least one), so no unknown word gets more than its part.

*Training.* Truncated backpropagation: a task runs many documents side by side, carries each state from window to window, and
backpropagates within a window. Every partition trains its own copy on its share of all training documents; after each of
``ROUNDS`` slices (a document is in one) copies are averaged by the words that they saw, in two steps of bounded groups.

*Scoring.* States are carried from the first word of a document to its end, whatever its length.

Defined cases: a null or empty text is one end; a null ``doc_id`` counts as the empty text for the split and stays null; repeated rows give
repeated results; without training texts the counts are 0 and scores are those of the untrained model; no row gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.llm.common import id_text, materialize, ship, tidy

HEAD_WORDS, NET_WORDS, CLASS_WORDS, SHAPES = 1 << 18, 1024, 64, 192
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 300_000
#: Punctuation that may follow a word.
CLOSING = b".,;:!?)]\"'"
HIDDEN, WINDOW, LANES, ROUNDS, RATE = 16, 24, 256, 2, 0.15
#: Where Adagrad's sums of squared gradients begin.
FIRST_SQUARE = 1e-4
#: Bytes of a word beyond which its digest stands for it.
LONG_WORD = 64
#: Numbers of a block of parameters; a row of the averaging.
BLOCK = 8192
#: Documents side by side when scoring, and steps at a time.
SCORE_LANES, SCORE_STEPS = 512, 24
CAPITALS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LN10 = math.log(10.0)
f32 = np.float32


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: ``bytes.split`` cuts at ASCII white space."""
    return (text or "").encode("utf-8").translate(CAPITALS).split()


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b" " + hashlib.sha256(word).hexdigest().encode()


def shape_of(word: bytes) -> int:
    return zlib.crc32(word.rstrip(CLOSING)[-2:]) % SHAPES


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c, shape`` of all words of a column ``text``: a task adds up its own words before they are shuffled."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words = list(found)
            columns = [pa.array([key_of(w).decode("utf-8") for w in words], pa.string()), pa.array(found.values(), pa.int64()), pa.array(map(shape_of, words), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["word", "c", "shape"])

        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                if len(found) >= COUNTED:
                    yield rows()
                    found.clear()
        yield rows()
        tidy()

    each = texts.select("text").mapInArrow(run, "word string, c long, shape int")
    return materialize(each.groupBy("word").agg(F.sum("c").alias("c"), F.min("shape").alias("shape")), "lm-counts")


@dataclass
class Lexicon:
    """What every task knows of the counts. Entry 0 is the end; entries follow by count."""

    index: dict[bytes, int]
    token: np.ndarray  # input and output symbol: a net word, or NET_WORDS + shape
    count: np.ndarray
    within: np.ndarray  # log probability within its shape class; 0 for net words
    net_counts: np.ndarray
    shape_counts: np.ndarray
    total: int
    distinct: int
    least_head: int  # words with a lower count are not in the index
    discount: float
    shape_types: np.ndarray
    shape_unseen: np.ndarray  # words of each shape class that are expected to exist beside those seen

    def unseen(self) -> np.ndarray:
        """Log probability of one word never seen within each shape class."""
        share = np.where(self.shape_counts > 0, self.discount * self.shape_types / np.maximum(self.shape_counts, 1), 1.0)
        return np.log(np.maximum(share, 1e-30)) - np.log(self.shape_unseen)


def expected_unseen(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Chao's estimate of the number of kinds not seen, from those seen once and twice; at least 1."""
    return np.maximum(1.0, once * (once - 1.0) / (2.0 * (twice + 1.0)))


def build_lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """Totals and the head of the counts; what is collected is at most ``HEAD_WORDS`` words of at most 66 bytes and a few sums."""
    octave = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum("c").alias("s")).orderBy(F.desc("o")).collect()
    total, distinct = sum(r.s for r in bins) + texts, sum(r.n for r in bins) + (texts > 0)
    held, least = 0, 1 << 62
    for r in bins:
        if held + r.n > HEAD_WORDS - 1:
            break
        held, least = held + r.n, r.least
    head = sorted(((r.c, r.word.encode("utf-8"), r["shape"]) for r in counts.filter(F.col("c") >= least).select("word", "c", "shape").collect()), key=lambda x: (-x[0], x[1]))
    rare = {r.c: r.n for r in counts.filter("c <= 2").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    discount = rare.get(1, 0) / max(1, rare.get(1, 0) + 2 * rare.get(2, 0)) or 0.5
    net = head[: NET_WORDS - 1]
    index = {b"": 0} | {w: i + 1 for i, (_, w, _) in enumerate(head)}
    count = np.array([texts, *(c for c, _, _ in head)], dtype=np.int64)
    shapes = np.zeros(SHAPES, dtype=np.int64)
    types = np.zeros(SHAPES, dtype=np.int64)
    once, twice = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.groupBy("shape").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect():
        shapes[r["shape"]], types[r["shape"]], once[r["shape"]], twice[r["shape"]] = r.s, r.n, r.n1, r.n2
    for c, _, shape in net:
        shapes[shape] -= c
        types[shape] -= 1
    token = np.array([0, *(i if i < NET_WORDS else NET_WORDS + shape for i, (_, _, shape) in enumerate(head, 1))], dtype=np.int32)
    within = np.zeros(len(token))
    tail = token >= NET_WORDS
    within[tail] = np.log(np.maximum(count[tail] - discount, 1e-9) / np.maximum(shapes[token[tail] - NET_WORDS], 1))
    net_counts = np.zeros(NET_WORDS)
    net_counts[: min(NET_WORDS, len(count))] = count[:NET_WORDS]
    return Lexicon(index, token, count, within, net_counts, shapes, total, distinct, least, discount, types, expected_unseen(once, twice))


SYMBOLS = NET_WORDS + SHAPES
CLASSES = SYMBOLS // CLASS_WORDS
SIZES = {"G": (SYMBOLS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "W": (SYMBOLS, HIDDEN), "w": (SYMBOLS,)}


def initial(lexicon: Lexicon) -> dict[str, np.ndarray]:
    """Small random weights; the biases give the counts' own distribution."""
    rng = np.random.default_rng(7)
    p = {k: (rng.standard_normal(s) * 0.15).astype(f32) for k, s in SIZES.items()}
    counts = np.r_[lexicon.net_counts, lexicon.shape_counts] + 0.5
    classes = counts.reshape(-1, CLASS_WORDS).sum(axis=1)
    p["c"] = np.log(classes / classes.sum()).astype(f32)
    p["w"] = np.log(counts / np.repeat(classes, CLASS_WORDS)).astype(f32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SIZES]).astype(f32)


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SIZES.items():
        n = math.prod(s)
        out[k], at = x[at : at + n].reshape(s).copy(), at + n
    return out


def side_by_side(lengths: np.ndarray, lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Deal documents to lanes of about equal length and walk all lanes at once, ``steps`` at a time: ``place`` (steps x running lanes, positions
    in the joined tokens or -1) and ``first`` (a document begins). Lanes are in falling length, so those that still run are the first ones. Memory is a
    number for each token and a window, however long a document is.
    """
    lanes = max(1, min(lanes, len(lengths)))
    heap = [(0, i) for i in range(lanes)]
    of: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        of[i].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), i))
    size = np.array([lengths[x].sum() for x in of])
    order = np.argsort(-size, kind="stable")
    size, dealt = size[order], np.array([d for i in order.tolist() for d in of[i]], dtype=np.int64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    n = lengths[dealt]
    begins = np.r_[0, np.cumsum(n)[:-1]]  # where each document begins among the lanes' tokens, one lane after the other
    position = np.arange(int(n.sum()), dtype=np.int64) + np.repeat(starts[dealt] - begins, n)
    new = np.zeros(len(position), dtype=bool)
    new[begins] = True
    lane = np.r_[0, np.cumsum(size)[:-1]]
    for a in range(0, int(size[0]), steps):
        m, b = int((size > a).sum()), min(a + steps, int(size[0]))
        at = np.arange(a, b)[:, None]
        real = at < size[:m]
        safe = np.where(real, at + lane[:m], 0)
        yield np.where(real, position[safe], -1), new[safe] & real


def gate(x: np.ndarray) -> np.ndarray:
    """The logistic function of ``-x``, in place: gates are parametrised with the opposite sign, which saves a pass."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


#: A bound on logits under which their exponentials need no shift in single precision.
SAFE_LOGIT = 60.0


def exponentials(x: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """``exp`` of each row's logits in place, and its sum; shifted by the row's largest where they may be large."""
    if bound > SAFE_LOGIT:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], dtype=f32)


def softmax_gradients(every: np.ndarray, total: np.ndarray, hit: np.ndarray, h: np.ndarray, w: np.ndarray, into: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Add a softmax's gradients for the outcomes ``hit`` to its weights and biases, return the states'; ``every`` are exponentials, undivided, and are used up."""
    share = (1 / total)[:, None]
    every[np.arange(len(hit)), hit] -= total
    found = (h * share).T @ every
    into += found[:-1]
    bias += found[-1]
    return (every @ w.T) * share


def output_scores(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of symbols ``y`` from states ``h``; with ``grads`` also adds the output layer's and returns the states' gradients. Works in the order of the classes."""
    n = np.arange(len(y))
    cls = (y // CLASS_WORDS).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cls, y = cls[order], y[order]
    edges = np.searchsorted(cls, np.arange(CLASSES + 1))
    h = np.concatenate([np.take(h, order, axis=0), np.ones((len(h), 1), f32)], axis=1)  # biases are the last row of the weights
    bound = float((np.abs(p["C"]).sum(axis=0) + np.abs(p["c"])).max())
    weights = np.concatenate([p["C"], p["c"][None]])
    every, total = exponentials(h @ weights, bound)
    found = np.log(every[n, cls] / total + f32(1e-30))
    part = None
    if grads is not None:
        part = softmax_gradients(every, total, cls, h, weights[:-1], grads["C"], grads["c"])
    weights = np.concatenate([p["W"], p["w"][:, None]], axis=1)
    bound = float(np.abs(weights).sum(axis=1).max())
    for k in np.flatnonzero(np.diff(edges)):
        at, rows = slice(edges[k], edges[k + 1]), slice(k * CLASS_WORDS, (k + 1) * CLASS_WORDS)
        every, total = exponentials(h[at] @ weights[rows].T, bound)
        pick = y[at] - k * CLASS_WORDS
        found[at] += np.log(every[n[: len(pick)], pick] / total + f32(1e-30))
        if grads is not None:
            part[at] += softmax_gradients(every, total, pick, h[at], p["W"][rows].T, grads["W"][rows].T, grads["w"][rows])
    score, back = np.empty_like(found), None
    score[order] = found
    if grads is not None:
        back = np.empty_like(part)
        back[order] = part
    return score, back


def by_gate(x: np.ndarray) -> np.ndarray:
    """The columns of the three gates as three arrays, each in one piece."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


def recur(p: dict[str, np.ndarray], x: np.ndarray, fresh: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state before each symbol and after the last (steps + 1 x lanes), both gates and the new part of every step, and what the state gives to the new part. ``fresh``: lanes where a document begins."""
    steps, lanes = x.shape
    gates, own = np.take(by_gate(p["G"]), x, axis=1), by_gate(p["U"])
    hs, us = np.empty((steps + 1, lanes, HIDDEN), f32), np.empty((steps, lanes, HIDDEN), f32)
    u = np.empty((2, lanes, HIDDEN), f32)
    hs[0] = h
    for t in range(steps):
        hs[t, fresh[t]] = 0
        zr, n = gates[:2, t], gates[2, t]
        zr += np.matmul(hs[t], own[:2], out=u)
        gate(zr)
        n += zr[1] * np.matmul(hs[t], own[2], out=us[t])
        np.tanh(n, out=n)
        after = np.subtract(hs[t], n, out=hs[t + 1])
        after *= zr[0]
        after += n
    return hs, gates, us


class Trainer:
    """Truncated backpropagation with Adagrad steps, a step for each window."""

    def __init__(self, p: dict[str, np.ndarray], squares: dict[str, np.ndarray]) -> None:
        self.p, self.squares, self.seen = p, squares, 0

    def run(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        state = np.zeros((LANES, HIDDEN), dtype=f32)
        for at, first in side_by_side(lengths, LANES, WINDOW):
            state = self.window(np.where(at >= 0, tokens[at], -1), first, state[: at.shape[1]])
        self.seen += len(tokens)

    def window(self, x: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, k = self.p, HIDDEN
        steps, lanes = x.shape
        fresh = [np.flatnonzero(row) for row in first]
        safe = np.maximum(x, 0)
        every, (z, r, n), us = recur(p, safe, fresh, h)
        hs = every[:-1]
        real = np.flatnonzero(x.ravel() >= 0)
        all_real = len(real) == x.size
        taken = lambda v: v if all_real else np.take(v, real, axis=0)
        g = {name: np.zeros_like(v) for name, v in p.items() if name != "G"}
        _, back = output_scores(p, taken(hs.reshape(-1, k)), taken(x.ravel()), g)
        if not all_real:
            part, back = back, np.zeros((steps * lanes, k), f32)
            back[real] = part
        back = back.reshape(steps, lanes, k)
        rest = 1 - z
        to_z, to_n, to_r = (n - hs) * z * rest, rest * (1 - n * n), us * (r - 1)
        dg, dn = np.empty((3, steps, lanes, k), f32), np.empty((steps, lanes, k), f32)
        dh = np.zeros((lanes, k), f32)
        ut = np.ascontiguousarray(by_gate(p["U"]).transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            np.multiply(dh, to_z[t], out=dg[0, t])
            np.multiply(dh, to_n[t], out=dg[2, t])
            np.multiply(dg[2, t], r[t], out=dn[t])
            np.multiply(dn[t], to_r[t], out=dg[1, t])
            dh *= z[t]
            dh += dg[0, t] @ ut[0]
            dh += dg[1, t] @ ut[1]
            dh += dn[t] @ ut[2]
            dh += back[t]
            dh[fresh[t]] = 0
        before = hs.reshape(-1, k).T
        g["U"] = np.concatenate([before @ d.reshape(-1, k) for d in (dg[0], dg[1], dn)], axis=1)
        self.step(g, taken(safe.ravel()), taken(np.concatenate(list(dg), axis=2).reshape(-1, 3 * k)), len(real))
        return every[-1]

    def step(self, g: dict[str, np.ndarray], x: np.ndarray, dg: np.ndarray, n: int) -> None:
        scale = f32(1.0 / max(1, n) ** 0.5)
        for name, v in g.items():
            v *= scale
            np.clip(v, -5, 5, out=v)
            self.squares[name] += v * v
            self.p[name] -= f32(RATE) * v / (np.sqrt(self.squares[name]) + f32(1e-3))
        order = np.argsort(x.astype(np.int16), kind="stable")  # symbols are few; numbers of 16 bits are sorted by radix
        x = x[order]
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        rows = x[starts]
        v = np.clip(np.add.reduceat(np.take(dg, order, axis=0), starts, axis=0) * scale, -5, 5)
        s = self.squares["G"][rows] + v * v
        self.squares["G"][rows] = s
        self.p["G"][rows] -= f32(RATE) * v / (np.sqrt(s) + f32(1e-3))


def score_tokens(p: dict[str, np.ndarray], tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of every symbol; states run from the first word of a document to its end."""
    out = np.zeros(len(tokens))
    h = np.zeros((SCORE_LANES, HIDDEN), f32)
    for at, first in side_by_side(lengths, SCORE_LANES, SCORE_STEPS):
        x = tokens[np.maximum(at, 0)]
        hs = recur(p, x, [np.flatnonzero(row) for row in first], h[: at.shape[1]])[0]
        h = hs[-1]
        real = np.flatnonzero(at.ravel() >= 0)
        out[at.ravel()[real]] = output_scores(p, np.take(hs.reshape(-1, HIDDEN), real, axis=0), x.ravel()[real])[0]
    return out


def indexed(lexicon: Lexicon, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Entries (-1: not in the head) of all words and ends of texts, their symbols, lengths, and the words outside the head with their place."""
    get, entries, lengths, outside, places, at = lexicon.index.get, [], [], [], [], 0
    for text in texts:
        words = words_of(text)
        found = np.zeros(len(words) + 1, np.int64)  # the last one is the end
        found[:-1] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(found < 0).tolist():
            w = words[i]
            if len(w) > LONG_WORD:
                found[i] = get(key_of(w), -1)
            if found[i] < 0:
                outside.append(w)
                places.append(at + i)
        entries.append(found)
        lengths.append(len(found))
        at += len(found)
    e = np.concatenate(entries)
    symbols = lexicon.token[np.maximum(e, 0)]
    places = np.array(places, dtype=np.int64)
    if len(places):
        symbols[places] = [NET_WORDS + shape_of(w) for w in outside]
    return e, symbols, np.array(lengths, dtype=np.int64), outside, places


def text_groups(texts: list[str | bytes | None], most: int = 6 << 20) -> Iterator[tuple[int, list]]:
    """Runs of texts (or packed symbols) of about ``most`` characters, with the place of the first."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def unpacked(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of documents stored as 16-bit numbers."""
    return np.frombuffer(b"".join(group), dtype="<u2").astype(np.int32), np.array([len(x) // 2 for x in group], dtype=np.int64)


def train(packed: DataFrame, first: Lexicon, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Train on ``(symbols, slice)``, slice by slice. The driver holds one set of parameters."""
    spark = packed.sparkSession
    start = flat(initial(first))
    weights = np.r_[start, np.full(len(start), FIRST_SQUARE, f32)]
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            both = sent.value
            half = len(both) // 2
            trainer = Trainer(unflat(both[:half]), unflat(both[half:]))
            for batch in batches:
                for _, group in text_groups(batch.column(0).to_pylist()):
                    trainer.run(*unpacked(group))
            if trainer.seen:
                x = np.r_[flat(trainer.p), flat(trainer.squares)] * f32(1.0)
                parts = [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)]
                salt = TaskContext.get().partitionId() // 64
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([float(trainer.seen)] * len(parts), pa.float64()), pa.array([y.tobytes() for y in parts], pa.binary())],
                    ["block", "salt", "seen", "x"],
                )
            tidy()

        copies = packed.filter(F.col("slice") == turn).select("symbols").mapInArrow(run, "block int, salt int, seen double, x binary")

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            seen = frame["seen"].to_numpy()
            x = sum(np.frombuffer(b, dtype=f32).astype(np.float64) * s for b, s in zip(frame["x"], seen, strict=True)) / seen.sum()
            return pd.DataFrame({"block": [frame["block"].iloc[0]], "seen": [seen.sum()], "x": [x.astype(f32).tobytes()]})

        some = copies.groupBy("block", "salt").applyInPandas(mean, "block int, seen double, x binary")
        got = some.groupBy("block").applyInPandas(mean, "block int, seen double, x binary").collect()
        if got:
            weights = np.concatenate([np.frombuffer(r.x, dtype=f32) for r in sorted(got, key=lambda r: r.block)])
        sent.unpersist()
    return unflat(weights[: len(weights) // 2])


def held_out(id_col: str, of: int, which: int) -> Column:
    return F.crc32(F.encode(id_text(id_col), "UTF-8")) % of == which


def score_documents(docs: DataFrame, learn: Column, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Train on the rows that ``learn`` admits and score all: ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score``."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"), learn.alias("learned"))
    training = rows.filter("learned").select(F.coalesce("text", F.lit("")).alias("text"))
    counts = word_counts(training)
    own = build_lexicon(counts, training.count())
    lexicon = spark.sparkContext.broadcast(own)
    base_all = math.log10(own.total + own.distinct + 1)
    slices = F.pmod(F.xxhash64(id_text("doc_id"), "text"), F.lit(ROUNDS)).cast("int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words to symbols, once; and all that needs no network."""
        lex = lexicon.value
        logs = np.log10(lex.count + 1.0)
        for batch in batches:
            for at, group in text_groups(batch.column(0).to_pylist()):
                entries, symbols, lengths, outside, places = indexed(lex, group)
                known = entries >= 0
                safe = np.maximum(entries, 0)
                ends = np.r_[0, np.cumsum(lengths)]
                per = lambda v, ends=ends: np.add.reduceat(v, ends[:-1])
                base = per(np.where(known, logs[safe], 0.0)) - lengths * base_all
                cut = np.searchsorted(places, ends)
                lists = lambda v, cut=cut: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), v)
                packed = symbols.astype("<u2").tobytes()
                columns = [
                    pa.array(lengths, pa.int64()), pa.array(per((known & (lex.count[safe] > 0)).astype(np.int64)), pa.int64()), pa.array(base, pa.float64()), pa.array(per(np.where(known, lex.within[safe], 0.0)), pa.float64()),
                    lists(pa.array([key_of(w).decode("utf-8") for w in outside], pa.string())), lists(pa.array(symbols[places] - NET_WORDS, pa.int32())),
                    pa.array([packed[2 * a : 2 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(group)) for c in batch.columns[1:]), *columns], ["doc_id", "learned", "slice", "n_tokens", "known", "base", "within", "tail", "shapes", "symbols"])
        tidy()

    kind = rows.schema["doc_id"].dataType.simpleString()
    words = rows.select("text", "doc_id", "learned", slices.alias("slice")).mapInArrow(read, f"doc_id {kind}, learned boolean, slice int, n_tokens long, known long, base double, within double, tail array<string>, shapes array<int>, symbols binary")
    scored = materialize(words.withColumn("rid", F.monotonically_increasing_id()), "lm-words")
    parameters = spark.sparkContext.broadcast(train(scored.filter("learned"), own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parameters.value
        for batch in batches:
            for at, group in text_groups(batch.column(0).to_pylist()):
                symbols, lengths = unpacked(group)
                net = np.add.reduceat(score_tokens(p, symbols, lengths), np.r_[0, np.cumsum(lengths)[:-1]])
                within = batch.column(1).slice(at, len(group)).to_numpy()
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(group)) for c in batch.columns[2:]), pa.array((net + within) / LN10, pa.float64())], [*batch.schema.names[2:], "net"])
        tidy()

    plain = scored.select("symbols", "within", "rid", "doc_id", "learned", "n_tokens", "known", "base")
    net_scores = plain.mapInArrow(run, f"rid long, doc_id {kind}, learned boolean, n_tokens long, known long, base double, net double")
    # Words outside the head: their counts are joined, hot words are not among them.
    tail = scored.select("rid", F.explode(F.arrays_zip("tail", "shapes")).alias("t")).select("rid", F.col("t.tail").alias("word"), F.col("t.shapes").alias("shape"))
    rare = counts.filter(F.col("c") < own.least_head).select("word", "c")
    mass = F.element_at(F.array(*[F.lit(float(max(1, x))) for x in own.shape_counts]), F.col("shape") + 1)
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in own.unseen()]), F.col("shape") + 1)
    joined = tail.join(rare, "word", "left")
    sums = joined.groupBy("rid").agg(
        F.count("c").alias("tail_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_base"),
        F.sum(F.when(F.col("c").isNull(), unseen).otherwise(F.log(F.greatest(F.col("c") - own.discount, F.lit(1e-9)) / mass))).alias("tail_net"),
    )
    out = net_scores.join(sums, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "learned", "n_tokens", (F.col("known") + zero("tail_known")).alias("n_known"), F.lit(own.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("net") + zero("tail_net") / LN10).alias("score"),
    )
