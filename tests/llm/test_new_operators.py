"""Suffix dedup, whitening and the Merkle manifest against brute-force versions, on odd rows too."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import conform.llm.merkle as mk
import conform.llm.suffix_dedup as sd
import conform.llm.toxicity as tx
import conform.llm.whitening as wh


def as_rows(df, *columns):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


# -- suffix dedup -----------------------------------------------------------


def kept(texts, size):
    """Brute force: every string of ``size`` bytes is counted."""
    starts = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if starts[t[i : i + size]] > 1:
                hit[i] += 1
                hit[i + size] -= 1
        on = np.cumsum(hit)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        out.append((len(t), int(on.sum()), runs, hashlib.sha256(bytes(b for b, o in zip(t, on) if not o)).hexdigest()))
    return out


def test_matching_statistics_of_the_run_index():
    rng = random.Random(3)
    for _ in range(25):
        pieces = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 7))]
        pieces = list(dict.fromkeys(pieces + [p[rng.randint(0, len(p) - 1) :] + b"ab" * rng.randint(0, 9) for p in pieces]))
        copies = np.array([rng.choice([1, 1, 2]) for _ in pieces])
        index = sd.RunIndex(pieces, copies)
        assert index.lengths.sum() == index.n and (index.symbols[1:] != index.symbols[:-1]).all()
        found, at = index.matching_statistics(), 0
        for k, p in enumerate(pieces):
            for i in range(len(p)):
                best = len(p) - i if copies[k] > 1 else 0
                for j, q in enumerate(pieces):
                    for m in range(len(q)):
                        if (j, m) != (k, i):
                            n = 0
                            while i + n < len(p) and m + n < len(q) and p[i + n] == q[m + n]:
                                n += 1
                            best = max(best, n)
                assert found[at + i] == best
            at += len(p) + 1


def odd_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(500)
    rows = [(i, prose(40) + base[i * 7 : i * 7 + rng.randint(380, 900)] + prose(20)) for i in range(40)]
    rows += [(100 + i, "x" * i + base[:600] + f"tail {i} " * rng.randint(0, 90)) for i in range(25)]
    return rows + [(None, None), (5, ""), (6, "y" * 399), (7, "y" * 400), (8, "z" * 401), (9, "ab" * 3000), (10, "é" * 500), (11, base), (11, base), (12, prose(60_000)), (13, base[3:] + "\0" * 900)]


@pytest.mark.parametrize(("most", "part"), [(2048, 1 << 20), (3, 5000)])
def test_repeats_are_removed_as_by_brute_force(spark, monkeypatch, most, part):
    """Small parts cut long texts; a low bound splits frequent anchors into strings."""
    monkeypatch.setattr(sd, "MOST_PIECES", most)
    monkeypatch.setattr(sd, "PART", part)
    monkeypatch.setattr(sd, "HOT_ROWS", 20)
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit(1), "anchor": F.lit("x"), "data": F.lit(2)}).repartition(3)
    got = as_rows(sd.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = [(i, *x) for (i, _), x in zip(rows, kept([(t or "").encode() for _, t in rows], sd.LENGTH))]
    assert got == sorted(want, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    assert sd.remove_repeats(df.limit(0)).count() == 0


# -- whitening --------------------------------------------------------------


@pytest.mark.parametrize("d", [1, 2, 3, 8, 64])
def test_leading_pairs(d):
    rng = np.random.default_rng(d)
    for kind in range(5):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        e = np.sort(rng.random(d))[::-1] * 100
        if kind == 1:
            e[:] = e[0]
        if kind == 2 and d > 2:
            e[1] = e[0] * (1 - 1e-9)
        if kind == 3:
            e[d // 2 :] = 0
        if kind == 4 and d > 2:
            e[1:3] = e[1]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        values, vectors = wh.leading_pairs(v)
        known = np.linalg.eigvalsh(v)
        assert np.allclose(values, known[::-1][: wh.COMPONENTS], rtol=1e-12, atol=1e-11)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-10 and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert all(wh.inertia(v, s) == (known < s).sum() for s in (0.3 * e[0] + 1e-3, e[-1] / 2 + 2e-3))


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.standard_normal(6) * [9, 4, 2, 1, 0.5, 0.1]]) for i in range(300)]
    odd = [(None, vectors[0][1]), (7, vectors[0][1]), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [1.0, 2.0]), (405, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("x", F.lit("y")).withColumn("component", F.lit(9)).repartition(3)
    got = wh.whiten(df).toPandas()
    rows = vectors + odd[:2] + [(404, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]), (405, [0.0] * 6)]
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    e, w = np.linalg.eigh((u - s / n).T @ (u - s / n) / n)
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for k in range(4):
        part = got[got.component == k + 1]
        want = (x - s / n) @ w[:, -1 - k] / np.sqrt(e[-1 - k])
        a, b = np.sort(part.whitened), np.sort(want)
        assert min(np.abs(a - b).max(), np.abs(a - np.sort(-want)).max()) < 1e-10 and abs(part.explained.iloc[0] - e[-1 - k] / e.sum()) < 1e-12
        assert sorted(part.deviation) == sorted(((n * x - s) ** 2).sum(axis=1))
    assert len(set(got[got.vec_id.isna() & (got.component == 1)].whitened) | set(got[(got.vec_id == 0) & (got.component == 1)].whitened)) == 1


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert wh.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0 and wh.whiten(spark.createDataFrame([], schema)).count() == 0
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one if r.vec_id == 1] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    line = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert [(r.component, round(r.explained, 12), None if r.whitened is None else round(abs(r.whitened), 12)) for r in line if r.vec_id == 2] == [(1, 1.0, 1.0), (2, 0.0, None)]
    far = wh.whiten(spark.createDataFrame([(i, [1e12 + i, 2.0 * (i % 3)]) for i in range(9)], schema)).collect()
    assert max(r.identity_error for r in far) < 1e-9 and {r.deviation for r in far if r.vec_id == 4} == {sum((9 * a - sum(c)) ** 2 for a, c in ((1024, [256 * i for i in range(9)]), (512, [512 * (i % 3) for i in range(9)])))}


# -- Merkle manifest --------------------------------------------------------


def manifest(rows):
    """Brute force: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(field, r))

    def tree(nodes):
        steps = [[] for _ in nodes]
        places = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(places):
                run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
                steps[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
            places = [p // 16 for p in places]
        return nodes[0], steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: tree([leaf(r) for r in ordered[s]]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, own in zip(ordered[s], trees[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            lower = r[4] if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            h = leaf((*r[:4], lower)) if hit else leaf(r)
            for a, b in own + top:
                h = sha(a, h, b)
            out.append((r[0], leaf(r), trees[s][0], root, sha(*[x for step in own + top for x in step]), h, h == root))
    return out


def test_manifest(spark):
    rng = random.Random(6)
    sizes = {"a": 1, "b": 16, "c": 17, "hot": 700, None: 257, "": 2, "é": 40, "z": 256}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((rng.choice([k, k, k, -k, None]), source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Text A", "text", None, "", "É Ü", "Q" * 5000])))
            k += 1
    rows += [rows[3]] * 30 + [(9, "hot", "en", 1, "SAME")] * 300
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).withColumns({"grp": F.lit("x"), "pos": F.lit(1), "leaf": F.lit(2)}).repartition(3)
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = as_rows(mk.dataset_manifest(df), *columns)
    assert got == sorted(manifest(rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, schema).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    found = con.execute(mk.sql()).fetchall()
    assert sorted(map(str, found)) == sorted(map(str, got))
    assert mk.dataset_manifest(df.limit(0)).count() == 0 and as_rows(mk.dataset_manifest(df.limit(1)), *columns)[0][1] == as_rows(mk.dataset_manifest(df.limit(1)), "root")[0][0]


# -- toxicity: quotation ----------------------------------------------------


@pytest.mark.parametrize(("text", "quoted"), [
    ("you’re an idiot and that’s it", False), ("you are an idiot and that is it", False), ("“nice” you idiot “ok”", False), ("he said “you idiot” to me", True), ('she wrote "what an idiot" then', True), ("„du idiot“ rief er", True),
    ("«quel idiot»", True), ("the dogs’ idiot owner’s dog", False), ("‘an idiot’", True), ('5" idiot and more', False), ("“ " + "so " * 80 + "idiot ”", False), ('"a" idiot "b"', False), ("don't call me 'idiot'", False),
])
def test_quotation_marks_are_paired(text, quoted):
    trie = tx.Trie()
    trie.add("idiot", False)
    assert [q for *_, q in tx.Scorer(trie, {(0, 0): 5.0}).hits(text)[0]] == [quoted]


def test_scores_by_brute_force():
    """Features recomputed with plain edit distances over all terms."""
    import math

    def distance(a, b):  # one edit: a letter put in, taken out or changed, or two neighbours swapped
        d = [[max(i, j) if min(i, j) == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = ["idiot", "moronic", "scumbag", "vile"]
    trie = tx.Trie()
    for t in terms:
        trie.add(t, False)
    weights = {(k, e): 3.0 + k - e for k in range(4) for e in range(3)}
    scorer = tx.Scorer(trie, weights, slope=np.array([1.0, 0.5, 0.2, 3.0, -0.5, -0.2, 1.0]), bias=-2.0, reports=frozenset({"said"}))
    rng = random.Random(7)
    words = [*terms, "idoit", "moronc", "scumbbag", "vil", "house", "said", "tree", '"', "“", "”", "don’t", "wind", "!", "rain", "river"]
    for _ in range(150):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = " ".join(parts)
        tokens = tx.TOKEN.findall(text)
        pairs, open_at = [], None
        for i, t in enumerate(tokens):
            if open_at is not None and t == {'"': '"', "“": "”"}[tokens[open_at]]:
                pairs.append((open_at, i))
                open_at = None
            elif open_at is None and t in ('"', "“") and ({'"': '"', "“": "”"}[t] in tokens[i + 1 :]):
                open_at = i
        hits = []
        for i, t in enumerate(tokens):
            near = [(e, k) for k, x in enumerate(terms) if (e := distance(t, x)) <= tx.edits_allowed(x)]
            if near:
                e, k = min(near)
                hits.append((k, e, any(a < i < b for a, b in pairs) or "said" in tokens[max(0, i - 6) : i + 7]))
        assert [h[:3] for h in scorer.hits(text)[0]] == hits
        abuse, quoted = [weights[k, e] for k, e, q in hits if not q], [weights[k, e] for k, e, q in hits if q]
        n = len(tokens)
        x = [math.log1p(sum(abuse)), max(abuse, default=0), math.log1p(len({k for k, _, q in hits if not q})), sum(abuse) / (n + 20), math.log1p(sum(quoted)), max(quoted, default=0), text.count("!") / (n + 20)]
        want = 1 / (1 + math.exp(-(np.dot(x, [1.0, 0.5, 0.2, 3.0, -0.5, -0.2, 1.0]) - 2.0)))
        assert abs(scorer.scores(np.array([scorer.features(text)]))[0] - want) < 1e-12


# -- sharding and the pipeline's stages on odd rows --------------------------


def test_many_alike_rows_are_numbered_in_blocks(spark):
    from conform.llm import rendezvous

    rows = [(7, "same")] * 5000 + [(None, None)] * 300 + [(i, f"t{i}") for i in range(200)]
    got = rendezvous.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(map(str, con.execute(rendezvous.sql()).fetchall())) == sorted(str(tuple(r)) for r in got)


@pytest.fixture
def odd_corpus(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(40), "en", ["a", "b", None][i % 3], 1) for i in range(120)]
    rows += [(500 + i, rows[0][1], "en", "a", 1) for i in range(30)] + [rows[5]] * 3 + [(None, None, None, None, None), (None, "", "en", "c", 0), (None, text(30), "en", "c", 2), (600, text(40_000), "en", "b", 1), (601, "é " * 20, "fr", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("__key", "__th0", "__id", "__th", "__n", "__times", "__source", "__copy", "th", "keeper", "toxic", "score"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, odd_corpus):
    """Nulls, copies, repeated rows, a long text and columns with the names that stages use inside; then no row at all."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, odd_corpus).cache()
        assert at.columns == docs.columns, name
        assert at.filter(" OR ".join(f"{c} <> 'own {c}'" for c in docs.columns[5:])).count() == 0, name
        if name == "near_duplicates":
            texts = [r.text for r in at.collect() if r.text]
            assert len(texts) == len(set(texts))
    last = corpus_pipeline.STAGES[-1][1](spark, at, odd_corpus)
    assert last.count() == at.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, odd_corpus)
        assert empty.count() == 0
        empty = empty if set(docs.columns) <= set(empty.columns) else docs.limit(0)
