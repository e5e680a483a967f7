"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell quotation from abuse.

Terms are mined from labelled documents: words, and stems (first letters of words), that stand in many more toxic
documents than clean ones. They make a trie. A word is held against it by running its Levenshtein automaton down the trie, so that
misspelled terms are found without listing misspellings; the automaton is a row of edit distances that dies as soon as
none is within the limit. Every hit is weighed by how its term and distance behave in the labelled documents: a
misspelling that is really a common word gets no weight. The context of each hit tells quotation from abuse: whether it stands between an opening mark and
the mark that closes it, and whether a window of words around it holds a word that reports another's words; these are learned as well: words that stand beside
hits in many more clean documents than toxic ones. An apostrophe inside of a word is no mark. Quoted and reported hits count apart, and a logistic model over the document's features learns what both mean.

What counts as "many more" is asked of chance: of as many words as there are, fewer than ``CHANCE`` in all would lean to one kind as much as a term
does if they did not care (Chernoff's bound). So the rule is the same at every size of the sample, and every term that passes it is taken.

Labels are read only from rows that ``learn`` admits, at most ``SAMPLE_ROWS`` of them by hash of the id (the fit is the only bounded step); every
document is scored whole. Defined cases: a null or empty text has the score of a text without hits; a null ``doc_id`` stays
null; repeated rows give repeated results; without labels of both kinds every score is 0; where no term tells the kinds apart, scores follow
the share of exclamation marks; no row gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.llm.common import id_text, materialize, ship, tidy

#: Labelled documents that the fit sees at most.
SAMPLE_ROWS = 40_000
#: Terms that may be taken by mere chance, in all; and the least ratio of a term's rates in toxic and clean documents.
CHANCE, LEAST_RATIO = 0.5, 20.0
#: The least ratio of a reporting word's rates beside hits, in clean over toxic documents.
LEAST_REPORT_RATIO = 3.0
STEMS = (4, 5, 6)
#: Words on each side of a hit that make its context.
WINDOW = 6
#: Words whose hit a worker remembers at most.
REMEMBERED = 200_000
FEATURES = 7
#: Words, and quotation marks; between two letters the single ones are apostrophes.
TOKEN = regex.compile(r"\w+|[\"“”«»„]|(?<!\w)[‘’]|[‘’](?!\w)")
#: Opening quotation marks with those that close them.
CLOSED_BY = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
QUOTES = frozenset('"“”«»„‘’')
#: Words between two marks up to which they are taken for a pair.
LONGEST_QUOTE = 60


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def stem_edits(stem: str) -> int:
    """As many as the shortest word that a stem stands for."""
    return edits_allowed(stem + "?")


#: States of the automaton that a worker keeps at most.
MOST_STATES = 200_000
#: In a state, in place of an owed letter: the stem of the node is found, whatever letters follow.
FOUND = "*"
#: Edits that mark "a letter of a swapped pair is still owed" in a state: (node, edits, letter).
State = frozenset[tuple[int, int, str]]


@dataclass
class Trie:
    """Nodes as dictionaries; a terminal holds its term's number, a stem's terminal also accepts all longer words.

    The Levenshtein automata of all terms run along the trie together (a stem's accepts every word that begins within its edits): a state is the set of (node, edits) that the letters
    read so far can reach, built when first met and kept. A word that is near no term soon meets the empty state.
    """

    after: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: list[int] = field(default_factory=lambda: [-1])
    stem: list[int] = field(default_factory=lambda: [-1])
    limit: list[int] = field(default_factory=lambda: [0])  # the most edits that a term below allows
    terms: list[str] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)  # that each term allows
    moves: list[dict[str, int]] = field(default_factory=list)
    states: list[State] = field(default_factory=list)
    number: dict[State, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"moves": [], "states": [], "number": {}}

    def add(self, term: str, is_stem: bool) -> None:
        edits = stem_edits(term) if is_stem else edits_allowed(term)
        at = 0
        for c in term:
            self.limit[at] = max(self.limit[at], edits)
            if c not in self.after[at]:
                self.after[at][c] = len(self.after)
                self.after.append({})
                self.word.append(-1)
                self.stem.append(-1)
                self.limit.append(0)
            at = self.after[at][c]
        self.limit[at] = max(self.limit[at], edits)
        (self.stem if is_stem else self.word)[at] = len(self.terms)
        self.terms.append(term + "*" if is_stem else term)
        self.edits.append(edits)

    def _state(self, reached: dict[tuple[int, str], int]) -> int:
        """Close a set over skipped letters of terms, and number it."""
        todo = list(reached.items())
        while todo:
            (node, owed), edits = todo.pop()
            if owed or reached[node, owed] < edits:
                continue
            for child in self.after[node].values():
                if edits + 1 <= self.limit[child] and reached.get((child, ""), 9) > edits + 1:
                    reached[child, ""] = edits + 1
                    todo.append(((child, ""), edits + 1))
        for (node, owed), edits in list(reached.items()):
            k = self.stem[node]
            if not owed and k >= 0 and edits <= self.edits[k]:
                reached[node, FOUND] = min(edits, reached.get((node, FOUND), 9))
        state = frozenset((n, e, o) for (n, o), e in reached.items())
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.number[state]

    def _move(self, at: int, c: str) -> int:
        reached: dict[tuple[int, str], int] = {}

        def reach(node: int, edits: int, owed: str = "") -> None:
            if edits <= self.limit[node] and reached.get((node, owed), 9) > edits:
                reached[node, owed] = edits

        for node, edits, owed in self.states[at]:
            if owed:
                if owed == FOUND:
                    reach(node, edits, FOUND)
                elif owed == c:
                    reach(node, edits)
                continue
            reach(node, edits + 1)  # c is one letter too many
            for x, child in self.after[node].items():
                reach(child, edits if x == c else edits + 1)
                if x != c and c in self.after[child]:
                    reach(self.after[child][c], edits + 1, x)  # c and x changed places
        return self._state(reached)

    def find(self, word: str) -> tuple[int, int] | None:
        """The nearest term and its distance: a whole term, a stem, or either within its allowed edits."""
        at, stem = 0, -1
        for c in word:
            at = self.after[at].get(c, -1)
            if at < 0:
                break
            if self.stem[at] >= 0:
                stem = self.stem[at]
        else:
            if self.word[at] >= 0:
                return self.word[at], 0
        if stem >= 0:
            return stem, 0
        if not self.states or len(self.states) > MOST_STATES:
            self.moves, self.states, self.number = [], [], {}
            self._state({})
            self._state({(0, ""): 0})
        at = 1  # 0 is the empty state
        for c in word:
            to = self.moves[at].get(c)
            if to is None:
                to = self.moves[at][c] = self._move(at, c)
            if not to:
                return None
            at = to
        ends = [(e, False, self.word[n]) for n, e, owed in self.states[at] if not owed and self.word[n] >= 0 and e <= self.edits[self.word[n]]]
        # a word that lacks a letter of the stem and has none after it is no inflection
        ends += [(e, True, self.stem[n]) for n, e, owed in self.states[at] if owed == FOUND and len(word) >= len(self.terms[self.stem[n]]) - 1]
        if not ends:
            return None
        edits, _, k = min(ends)
        return k, edits


def quoted_places(words: list[str]) -> set[int]:
    """The places between an opening mark and the next mark that closes it. A mark that is not closed within ``LONGEST_QUOTE`` words opens nothing."""
    out: set[int] = set()
    marks = [i for i, w in enumerate(words) if w in QUOTES]
    k = 0
    while k < len(marks):
        start = marks[k]
        ends = CLOSED_BY.get(words[start], "")
        end = next((m for m in range(k + 1, len(marks)) if words[marks[m]] in ends and marks[m] - start <= LONGEST_QUOTE + 1), None) if ends else None
        if end is None:
            k += 1
        else:
            out.update(range(start + 1, marks[end]))
            k = end + 1
    return out


@dataclass
class Scorer:
    """The trie, a weight for each (term, distance), and the logistic model."""

    trie: Trie
    weights: dict[tuple[int, int], float]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    slope: np.ndarray | None = None
    bias: float = 0.0
    reports: frozenset[str] = frozenset()
    known: dict[str, tuple[int, int] | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def hit(self, word: str) -> tuple[int, int] | None:
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.trie.find(word)
            return found

    def hits(self, text: str) -> tuple[list[tuple[int, int, bool]], int]:
        """(term, distance, quoted) of every hit, and the number of words."""
        words = TOKEN.findall(text.lower())
        at = [(i, h) for i, w in enumerate(words) if (h := self.hit(w)) is not None]
        inside = quoted_places(words) if at else set()
        found = [(*h, i in inside or not self.reports.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])) for i, h in at]
        return found, len(words)

    def beside(self, text: str) -> list[str]:
        """The distinct words in the windows of a text's hits that are no hits themselves."""
        words = TOKEN.findall(text.lower())
        at = [i for i, w in enumerate(words) if self.hit(w) is not None]
        return sorted({w for i in at for w in words[max(0, i - WINDOW) : i + WINDOW + 1] if w not in QUOTES and self.hit(w) is None})

    def features(self, text: str) -> list[float]:
        found, n = self.hits(text)
        abuse = [self.weights.get((k, d), 0.0) for k, d, quoted in found if not quoted]
        quoted = [self.weights.get((k, d), 0.0) for k, d, q in found if q]
        total = sum(abuse)
        return [math.log1p(total), max(abuse, default=0.0), math.log1p(len({k for k, _, q in found if not q and self.weights.get((k, _), 0.0) > 0})), total / (n + 20), math.log1p(sum(quoted)), max(quoted, default=0.0), text.count("!") / (n + 20)]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.slope is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(((features - self.mean) / self.spread) @ self.slope + self.bias, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> None:
        """Logistic regression by Newton's steps; at 0.3 the score errs towards finding."""
        self.mean, self.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.hstack([(x - self.mean) / self.spread, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0] * 0.1
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y) + ridge * 0.1 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.bias = w[:-1], float(w[-1])


def evidence(a: str, b: str, share: float) -> Column:
    """Minus the logarithm of Chernoff's bound of the chance that ``a`` of ``a + b`` documents are of a kind that has this share; 0 if they are not more than that."""
    n = F.col(a) + F.col(b)
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / n / p)).otherwise(0.0)
    return F.when(F.col(a) > n * share, part(a, share) + part(b, 1 - share)).otherwise(0.0)


def leaning(terms: DataFrame, of_a: int, of_b: int, ratio: float) -> DataFrame:
    """Rows of ``a, b`` that lean to the first kind beyond chance, with at least this ratio of smoothed rates."""
    least = math.log(max(1, terms.count()) / CHANCE)
    rates = (F.col("a") / of_a) / ((F.col("b") + 0.5) / of_b)
    return terms.filter((evidence("a", "b", of_a / (of_a + of_b)) >= least) & (rates >= ratio))


def learn_reports(sample: DataFrame, scorer: Scorer) -> frozenset[str]:
    """Words that stand beside hits in many more clean documents than toxic ones, of those that have hits."""
    rows = _map(sample, ["toxic"], "words array<string>", lambda texts: {"words": pa.array([scorer.beside(x) for x in texts], pa.list_(pa.string()))}).filter(F.size("words") > 0)
    rows = materialize(rows, "toxicity-windows")
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    clean = n - (toxic or 0)
    if not toxic or not clean:
        return frozenset()
    words = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("a"), F.sum("toxic").alias("b"))
    found = leaning(materialize(words, "toxicity-beside"), clean, toxic, LEAST_REPORT_RATIO)
    return frozenset(r.word for r in found.select("word").collect())


def mine_terms(sample: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems of ``(text, toxic)`` that tell toxic documents; each document counts once for a term."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?U)\w+"), F.lit(0)))
    rows = sample.select("toxic", F.col("toxic").cast("long").alias("y"), words.alias("words"))
    totals = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    toxic, clean = int(totals[0] or 0), int(totals[1] - (totals[0] or 0))
    if not toxic or not clean:
        return []
    forms = [F.transform("words", lambda w: F.concat(F.lit("w"), w))]
    forms += [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.lit(f"{n}"), F.substring(w, 1, n))) for n in STEMS]
    terms = rows.select("y", F.explode(F.array_distinct(F.concat(*forms))).alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    terms = terms.withColumn("b", F.col("n") - F.col("a"))
    found = leaning(materialize(terms, "toxicity-terms"), toxic, clean, LEAST_RATIO).select("term", "a").collect()  # terms of a bounded sample
    return choose_terms({r.term: r.a for r in found})


def choose_terms(found: dict[str, int]) -> list[tuple[str, bool]]:
    """From marked terms (``w`` before words, the length before stems) with their toxic documents: stems that say more than
    any one word of theirs, as long as they can be without losing documents, then the words that no stem covers. The words that a
    kept stem covers stay beside it: misspellings are nearer to a word than to its stem."""
    words = {t[1:]: a for t, a in found.items() if t[0] == "w"}
    stems = {t[1:]: a for t, a in found.items() if t[0] != "w"}
    kept: list[str] = []
    for s in sorted(stems, key=len):
        if any(s.startswith(x) for x in kept) or any(w.startswith(s) and a >= 0.8 * stems[s] for w, a in words.items()):
            continue
        longer = [x for x in stems if x.startswith(s) and stems[x] >= 0.95 * stems[s]]
        kept.append(max(longer, key=len))
    alone = [w for w in words if not any(w.startswith(s) for s in kept)]
    ranked = sorted([(w, False, words[w]) for w in alone] + [(x, True, stems[x]) for x in kept], key=lambda x: (-x[2], x[0]))
    top = [(t, s) for t, s, _ in ranked]
    stemmed = tuple(t for t, s in top if s)
    return top + [(w, False) for w in sorted(words, key=lambda w: (-words[w], w)) if w.startswith(stemmed)]


def _map(docs: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """Apply ``make(texts) -> arrays`` to the column ``text``, the last of ``columns``."""
    source = docs.select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = make([x or "" for x in batch.column(len(columns)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *arrays.values()], [*columns, *arrays])
        tidy()

    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in columns)
    return source.mapInArrow(run, f"{kinds}, {schema}")


def fit_scorer(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", id_col: str = "doc_id") -> Scorer:
    """Learn terms, weights and model from labelled documents that ``learn`` admits."""
    rows = docs.filter(learn).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    marks = labels.filter(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("__h", F.conv(F.substring(F.md5(id_text("doc_id")), 1, 8), 16, 10).cast("double") / float(1 << 32))
    share = min(1.0, SAMPLE_ROWS / max(1, marks.count()))
    sample = materialize(rows.join(marks.filter(F.col("__h") < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id"), "toxicity-sample")
    trie = Trie()
    for term, is_stem in mine_terms(sample):
        trie.add(term, is_stem)
    scorer = Scorer(trie, {})

    def found(texts: list[str]) -> dict[str, pa.Array]:
        hits = [sorted({(k * 4 + d) for k, d, _ in scorer.hits(x)[0]}) for x in texts]
        return {"hits": pa.array(hits, pa.list_(pa.int32()))}

    counts = _map(sample, ["toxic"], "hits array<int>", found).select("toxic", F.explode("hits").alias("hit")).groupBy("hit").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    total, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    base = math.log(((toxic or 0) + 1) / (total - (toxic or 0) + 1))
    for r in counts:
        spread = math.sqrt(1 / (r.a + 0.5) + 1 / (r.n - r.a + 0.5))  # what few documents say counts for less
        scorer.weights[r.hit // 4, r.hit % 4] = max(0.0, math.log((r.a + 0.5) / (r.n - r.a + 0.5)) - base - spread)
    if 0 < (toxic or 0) < total:
        if trie.terms:
            scorer.reports = learn_reports(sample, scorer)
        # a misspelling that the sample lacks: as its term, less for each edit
        for k in range(len(trie.terms)):
            for d in range(1, trie.edits[k] + 1):
                scorer.weights.setdefault((k, d), scorer.weights.get((k, 0), 0.0) * 0.7**d)
        rows = _map(sample, ["toxic"], "features array<double>", lambda texts: {"features": pa.array([scorer.features(x) for x in texts], pa.list_(pa.float64()))}).toPandas()
        if len(rows) and 0 < rows.toxic.sum() < len(rows):
            scorer.fit(np.array(rows.features.tolist()), rows.toxic.to_numpy(dtype=float))
    return scorer


def held_out(id_col: str, of: int, which: int) -> Column:
    return F.crc32(F.encode(id_text(id_col), "UTF-8")) % of == which


def score_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, score, predicted`` of every document. No shuffle."""
    ship(docs.sparkSession)

    def scored(texts: list[str]) -> dict[str, pa.Array]:
        s = scorer.scores(np.array([scorer.features(x) for x in texts]).reshape(-1, FEATURES))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())}

    return _map(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")), ["doc_id"], "score double, predicted int", scored)


def clean_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents, all columns, whose score is under the threshold. No shuffle."""
    ship(docs.sparkSession)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            s = scorer.scores(np.array([scorer.features(x or "") for x in batch.column(at).to_pylist()]).reshape(-1, FEATURES))
            yield batch.filter(pa.array(s < threshold))
        tidy()

    return docs.mapInArrow(keep, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from labelled rows whose crc32 of the id is not 2 modulo 4, score all: ``doc_id, held_out, score, predicted``."""
    ship(docs.sparkSession)
    scorer = fit_scorer(docs, labels, ~held_out("doc_id", 4, 2))
    rows = score_documents(docs, scorer, threshold)
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
