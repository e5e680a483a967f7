"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

1. Every text becomes its set of ``n`` consecutive lower-case words (64-bit hashes) and a MinHash signature. Documents with
   equal sets form a *class* that is represented once from here on, however many copies it has.
2. Signatures are cut into bands; bands and rows come from the similarity and the target recall. Representatives that share a band hash meet
   in a bucket. A bucket is dealt out in blocks, bounded in members and in n-grams, and pairs of blocks are tasks of bounded size, so no bucket is ever
   in one task, and a text travels once for each block of its buckets.
3. A pair belongs to the first band that it shares, so each is looked at once. Pairs whose signatures agree far less than
   they would at the wanted similarity go; for what is left the texts are fetched and the sets are compared exactly.
4. A block pair returns a count of links for each representative and a spanning forest of its links, never its pairs, so the rows
   stay proportional to the members. Links are added up; the forest's components, by least labels and pointer jumping, are the classes.

Defined cases: a text of fewer than ``n`` words has one n-gram, all its words; a text without words has none and is linked to nothing;
a null text counts as empty; null ids are the greatest in the choice of a class's name; repeated rows are copies of each other; no row
gives no row; other columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conform.llm.common import WORD, free_names, materialize, ship, tidy

N, SIMILARITY, RECALL = 5, 0.8, 0.9998
#: Representatives of a block, and n-grams of all of them, about: a task compares at most two blocks.
BLOCK, BLOCK_GRAMS = 2048, 1 << 20
#: Members of a bucket, and neighbours of a node, beyond which it is joined through a broadcast table of its own kind instead of a shuffle.
HOT_BUCKET, HUB = 4096, 512
#: Names of documents (two numbers each) up to which their table is broadcast.
FEW = 500_000
#: Standard errors by which a pair's signature may fall short of the wanted similarity.
SLACK = 6.0
SPLIT = regex.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 72) -> tuple[int, int]:
    """Bands and rows a band: the longest band that reaches the recall at the similarity within ``most`` hashes in all."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches that recall")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift until every bit depends on every other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct n-gram hashes of texts; word hashes are remembered up to a bound."""

    def __init__(self, n: int = N, most: int = 200_000) -> None:
        self.n, self.most, self.known = n, most, {}

    def words(self, text: str) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in SPLIT.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8"))
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text or "")
        if not len(words):
            return words
        n = min(self.n, len(words))
        rolled = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            rolled = mixed(rolled * _MIX + words[i : len(words) - n + 1 + i])
        return np.unique(rolled)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least ``a * x + b`` for each permutation; long sets in parts."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 2048):
        np.minimum(least, (grams[i : i + 2048, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, th`` (hash of the text)``, grams`` (their number)``, digest`` (of the set)``, sig``; no shuffle."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("th"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, (a, b) = Shingler(n), permutations(bands * rows)
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for x in batch.column(2):
                grams = shingle(x.as_py())
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                sigs.append(signature(grams, a, b).tobytes() if len(grams) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "th", "grams", "digest", "sig"])
        tidy()

    kind = source.schema["doc_id"].dataType.simpleString()
    return materialize(source.mapInArrow(run, f"doc_id {kind}, th long, grams long, digest binary, sig binary"), "ngram-signatures")


def candidate_pairs(sigs: np.ndarray, group: np.ndarray, side: np.ndarray, band: np.ndarray, rows: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the same group to compare: from different sides where the group has two, agreeing first in the
    group's band, and in at least ``least`` of the signature. ``group`` is sorted."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(group)], strict=True):
        if e - s < 2:
            continue
        first, of = sigs[s:e], side[s:e]
        right_side = np.flatnonzero(of == 1)
        for i in np.flatnonzero(of == 0).tolist():
            rest = right_side if len(right_side) else np.arange(i + 1, e - s)
            if not len(rest):
                continue
            same = first[rest] == first[i]
            whole = same.reshape(len(rest), -1, rows).all(axis=2)
            ok = (whole.argmax(axis=1) == band[s]) & whole[:, band[s]] & (same.mean(axis=1) >= least)
            if ok.any():
                right.append(s + rest[ok])
                left.append(np.full(int(ok.sum()), s + i))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches cut so that a key is never in two of them; rows come sorted by key."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(held):
            continue
        last = held[key].iloc[-1]
        at = int(np.argmax((held[key] == last).to_numpy()))
        if at:
            yield held.iloc[:at].reset_index(drop=True)
            held = held.iloc[at:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def split_join(rows: DataFrame, facts: DataFrame, on: list[str], several: int) -> DataFrame:
    """Join facts (one row for each key, with a column ``hot``) to rows. The ``several`` facts of hot keys are broadcast, if they are not too many, and
    their rows stay where they are instead of filling a task; a key is hot only if it has many rows, so there are far fewer of them than rows."""
    if not 0 < several <= FEW:
        return rows.join(facts.drop("hot"), on)
    hot = facts.filter("hot").drop("hot")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter("NOT hot").drop("hot"), on))


def _side_by_side(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def verified_links(classes: DataFrame, texts: DataFrame, bands: int, rows: int, similarity: float = SIMILARITY, n: int = N) -> DataFrame:
    """From ``classes`` (``digest, sig, copies, grams, doc_id, th``) and ``texts`` (``doc_id, th, text``): ``a, b, links, forest``.

    A row with ``b`` null says that ``a`` has ``links`` linked documents outside its class in one task; others are forest edges.
    """
    width = bands * rows
    least = max(0.0, similarity - SLACK * math.sqrt(similarity * (1 - similarity) / width))
    step = 4 * rows
    members = classes.filter(F.octet_length("sig") > 0).select("digest", "grams", "sig", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * step + 1, F.lit(step))))).alias("band", "bucket"))
    members = materialize(members.select("digest", "grams", "band", "bucket"), "ngram-bands")
    blocks = F.least(F.col("m"), F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("g") / BLOCK_GRAMS))).cast("int")
    sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("g")).filter("m > 1")
    sizes = materialize(sizes.select("band", "bucket", (F.col("m") > HOT_BUCKET).alias("hot"), blocks.alias("blocks")), "ngram-buckets")
    met = split_join(members, sizes, ["band", "bucket"], sizes.filter("hot").count())
    met = met.withColumn("block", F.pmod(F.xxhash64("digest", "band"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select("digest", "band", F.xxhash64("band", "bucket", low, high).alias("task"), ((low != high) & (F.col("block") == high)).cast("int").alias("side"))
    dealt = met.join(classes.select("digest", "sig"), "digest")

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, "task"):
            sigs = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint32).reshape(len(frame), width)
            i, j = candidate_pairs(sigs, frame["task"].to_numpy(), frame["side"].to_numpy(), frame["band"].to_numpy(), rows, least)
            yield frame.iloc[np.unique(np.r_[i, j]).astype(np.int64)][["task", "side", "band", "digest"]]
        tidy()

    wanted = materialize(_side_by_side(dealt, "task").mapInPandas(needed, "task long, side int, band int, digest binary"), "ngram-wanted")
    keepers = wanted.select("digest").distinct().join(classes, "digest")
    names = keepers.select("doc_id", "th")
    if wanted.select("digest").distinct().count() <= FEW:
        texts = texts.alias("t").join(F.broadcast(names.alias("k")), F.expr("t.doc_id <=> k.doc_id AND t.th = k.th"), "left_semi")
    full = texts.join(keepers, (texts["doc_id"].eqNullSafe(keepers["doc_id"])) & (texts["th"] == keepers["th"])).select("digest", "sig", "copies", "text").dropDuplicates(["digest"])
    full = wanted.join(full, "digest")

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for frame in _groups(frames, "task"):
            sigs = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint32).reshape(len(frame), width)
            task, side = frame["task"].to_numpy(), frame["side"].to_numpy()
            i, j = candidate_pairs(sigs, task, side, frame["band"].to_numpy(), rows, least)
            digests, copies = frame["digest"].to_numpy(), frame["copies"].to_numpy()
            starts = np.r_[np.flatnonzero(np.r_[True, task[1:] != task[:-1]]), len(task)]
            for s, e in zip(starts, starts[1:], strict=False):
                at = (i >= s) & (i < e)
                if not at.any():
                    continue
                x, y = i[at] - s, j[at] - s
                ok = linked([shingle(t) for t in frame["text"].iloc[s:e]], x, y, similarity)
                x, y = x[ok], y[ok]
                if not len(x):
                    continue
                counts = np.bincount(x, copies[s + y], e - s) + np.bincount(y, copies[s + x], e - s)
                some = np.flatnonzero(counts)
                roots = forest(e - s, x, y)
                edge = np.flatnonzero(roots != np.arange(e - s))
                yield pd.DataFrame({"a": [*digests[s + some], *digests[s + edge]], "b": [*[None] * len(some), *digests[s + roots[edge]]], "links": [*counts[some].astype(np.int64), *[0] * len(edge)]})
        tidy()

    return materialize(_side_by_side(full, "task").mapInPandas(verified, "a binary, b binary, links long"), "ngram-links")


def linked(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard index of at least ``similarity``, exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(x) <= 4 * len(sets):
        common = np.array([_common(sets[a], sets[b]) for a, b in zip(x, y, strict=True)])
    else:  # many pairs: members and n-grams as a 0/1 matrix, in strips of n-grams
        grams, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        total = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for start in range(0, len(grams), 4096):
            lo, hi = np.searchsorted(at, [start, start + 4096])
            strip = np.zeros((len(sets), min(4096, len(grams) - start)), dtype=np.float32)
            strip[owner[lo:hi], at[lo:hi] - start] = 1
            total += strip @ strip.T
        common = total[x, y].astype(np.int64)
    return common >= similarity * (sizes[x] + sizes[y] - common) - 1e-9


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def forest(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of the component of every node of ``edges`` (``a, b``). Each round takes the least label
    of all neighbours, then the label's own label; rounds grow with the logarithm of the longest path."""
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "component-edges")
    first = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"), (F.count(F.lit(1)) > HUB).alias("hot"))
    first = materialize(first, "component-labels")
    hubs, labels = materialize(first.filter("hot").select("node"), "component-hubs"), first.select("node", "label")
    several = hubs.count()
    while True:
        facts = labels.join(F.broadcast(hubs.withColumn("hot", F.lit(True))), "node", "left") if 0 < several <= FEW else labels.withColumn("hot", F.lit(None).cast("boolean"))
        facts = facts.select(F.col("node").alias("other"), "label", F.coalesce("hot", F.lit(False)).alias("hot"))
        near = split_join(both, facts, ["other"], several).groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(lower.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")), "component-labels")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = N, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for every document: ``doc_id, th, class_id, n_links, class_size, keeper``.

    ``class_id`` is the least id among the documents that links join to it, ``n_links`` the number of other documents whose n-gram sets have at least
    that similarity to its own (copies count each), ``keeper`` true for one row of every class (all rows that tie with it in id and text).
    """
    bands, rows = choose_bands(similarity, recall)
    signed = signatures(docs, bands, rows, n, text, id_col)
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = signed.filter("grams > 0").groupBy("digest").agg(F.min(name).alias("least"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig"), F.min("grams").alias("grams"))
    classes = materialize(classes.select("digest", "sig", "copies", "grams", "least", F.col("least.doc_id").alias("doc_id"), F.col("least.th").alias("th")), "ngram-classes")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("th"), F.col(text).cast("string").alias("text"))
    links = verified_links(classes, texts, bands, rows, similarity, n)
    counts = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    labels = components(links.filter(F.col("b").isNotNull()).select("a", "b")).withColumnsRenamed({"node": "digest"})
    known = classes.join(counts, "digest", "left").join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    groups = known.groupBy("label").agg(F.min("least").alias("first"), F.sum("copies").alias("class_size"))
    known = materialize(known.join(groups, "label").select("digest", "first", "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "ngram-known")
    out = signed.join(known, "digest", "left")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    return out.select(
        "doc_id", "th", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("first").eqNullSafe(own) | F.col("first").isNull(), F.lit(True)).alias("keeper"),
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = N, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents, all columns, one of each class: the least id stays. Rows equal in id and text to a keeper are one document."""
    joined = jaccard_join(docs, similarity, recall, n, text, id_col)
    own, other, hashed, rank = free_names(docs, "__th0", "__id", "__th", "__n")
    th = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    gone = materialize(joined.filter(~F.col("keeper")).select(F.col("doc_id").alias(other), F.col("th").alias(hashed)).distinct(), "ngram-gone")
    few = gone.count() <= FEW
    alike = F.col(id_col).eqNullSafe(F.col(other)) & (F.col(own) == F.col(hashed))
    kept = docs.withColumn(own, th).join(F.broadcast(gone) if few else gone, alike, "left_anti")
    repeated = materialize(joined.filter("keeper").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(other), F.col("th").alias(hashed)), "ngram-repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(repeated, alike, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(id_col, own).orderBy(id_col))).filter(F.col(rank) == 1)
    return kept.join(repeated, alike, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


#: The join in DuckDB's SQL, by brute force on the n-grams.
SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {N - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE c >= {SIMILARITY} * (s.n + t.n - c) - 1e-9),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x, min(y) AS class_id, count(*) AS class_size FROM reach GROUP BY x)
SELECT c.x AS doc_id, class_id, class_size, (SELECT count(*) FROM links l WHERE l.x = c.x) AS n_links FROM classes c
"""
