"""Each operator against brute force, on rows that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import io
import math
import random
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import conform.llm.fingerprints as fp
import conform.llm.gru_lm as lm
import conform.llm.ngram_join as nj
import conform.llm.source_mixing as sm
import conform.llm.toxicity as tx
from public_tokenizers import PATTERN

from conform.llm import bpe_codec, media_columns, rendezvous, token_counts, warc_zip
from conform.llm.queries import tokenizer_path

WORDS = "the of and tion ing über naïve café 東京 test's I'll don't 123 4567 ... !! <|endoftext|> x".split(" ")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, size string, taken string, fingerprint string, shard string"


def texts():
    rng = random.Random(3)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    return [*out, out[0], out[0], "", None, "  \n\t ", "a" * 3000, " ".join(rng.choice(WORDS) for _ in range(6000)), "é", " x y", "👍🏽 ok\r\n\r\n  z "]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i, x, "en", [None, "b", "a"][i % 3], -1, 7, "s", "t", "f", "h") for i, x in enumerate(t)]
    rows += [rows[4], rows[4], (None, "null id", None, "a", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def key(rows):
    return sorted(map(repr, rows))


def test_tokens_equal_the_library(docs, plain):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t, _ in plain]
    got = token_counts.count_tokens(docs, tokenizer_path(), P.PATTERN).collect()
    assert key(map(tuple, got)) == key((i, len((t or "").encode()), len(x), len(x) > 1024) for (i, t, _), x in zip(plain, ids, strict=True))
    got = bpe_codec.round_trip(docs, tokenizer_path()).collect()
    want = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _, _), x in zip(plain, ids, strict=True)]
    assert key(map(tuple, got)) == key(want)
    both = bpe_codec.encode_documents(docs, tokenizer_path()).collect()
    assert key((r.doc_id, r.ids) for r in both) == key((i, x) for (i, _, _), x in zip(plain, ids, strict=True))


def test_chunks_are_shared_and_joins_repaired():
    rng = random.Random(5)
    shared = " ".join(rng.choice(WORDS) for _ in range(3000))
    a, b = bpe_codec.chunks("one " + shared), bpe_codec.chunks("quite another start " + shared)
    assert len(set(a) & set(b)) > 0.8 * len(a)
    codec = bpe_codec.codec(tokenizer_path(), PATTERN)
    for text in ["x" * 5000, "a b" * 900, "\n \n" * 700, shared, "é" * 3000, "<|endoftext|>" * 300]:
        assert "".join(bpe_codec.pieces(bpe_codec.chunks(text))) == text
        (ids,) = codec.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


def test_pieces_lose_nothing_at_separators():
    for part in ("abc\x1f def", "a\x1f \n", "a b\x1c  c", "x\x1d y\x1e z", " \x1f  "):
        assert "".join(bpe_codec.pieces([part, "tail"])) == part + "tail"


def test_joins_that_do_not_agree_are_encoded_again(monkeypatch):
    own = bpe_codec.ChunkCodec(tokenizer_path(), PATTERN)
    whole = lambda t: own.tokenizer.encode(t, add_special_tokens=False).ids
    rng = random.Random(12)
    texts = ["".join(rng.choice(["the", "ing", " of", "  ", "\x1f ", "\x1c", " naïve", "東京", "\n", "'ll", "12345"]) for _ in range(700)) for _ in range(6)]
    for cut in (bpe_codec.pieces, lambda parts: parts):  # second: joins inside words
        monkeypatch.setattr(bpe_codec, "pieces", cut)
        own.pieces = bpe_codec.Memory(20_000)  # so small that both generations are forgotten many times
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole(t) for t in texts]


def test_memory_forgets_what_is_not_used():
    memory = bpe_codec.Memory(40)
    for i in range(100):
        memory.put(f"{i:04}", b"x")
        assert memory.get("0000") == b"x"
    assert memory.get("0050") is None and len(memory.young) + len(memory.old) <= 11


def test_fingerprints(spark, docs, plain):
    got = fp.fingerprint_likeness(docs).collect()
    order = sorted(plain, key=lambda r: (r[0] is None, -(r[0] or 0)))
    full = [t or "" for i, t, _ in order]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for j, (i, t, _) in enumerate(order):
        if i in (None, 4) or order[(j + 1) % len(order)][0] is None:
            continue
        t, nxt = t or "", full[(j + 1) % len(full)]
        third = len(t) // 3
        r = by[i][0]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest())
    prints = {(r.doc_id, r.fingerprint) for r in got}
    assert len({f for i, f in prints if i in (0, 30, 31)}) == 1
    assert all(r.near_next in (0.0, 1.0) for r in got) and len(got) == len(plain)
    same = spark.createDataFrame([(1, "Straße  ﬁn"), (2, "strasse fin "), (3, "other"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint_documents(same).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5]
    assert fp.fingerprint_likeness(same.limit(0)).count() == 0
    assert fp.fingerprint_likeness(same.filter("doc_id = 1")).first().near_next == 1.0


def test_fingerprints_tell_texts_with_equal_hashes_apart(spark, monkeypatch):
    monkeypatch.setattr(fp, "wide_hash", lambda col: F.substring(F.lpad(F.hex(F.length(col)), 4, "0"), 1, 4))
    rows = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "abc")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint_documents(rows).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 3


def test_sharding(docs, plain):
    got = rendezvous.shard_documents(docs).collect()
    assert key((r.doc_id, r["size"], r.text_crc32) for r in got) == key((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in plain)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert rendezvous.shard_documents(docs.limit(0)).count() == 0


def test_rendezvous_follows_weights(spark):
    ids = spark.range(40000).select(F.col("id").cast("string").alias("k"))
    counts = Counter(r.s for r in ids.select(rendezvous.shard_of(F.col("k"), [1.0, 2.0, 5.0]).alias("s")).collect())
    assert [round(counts[i] / 5000) for i in range(3)] == [1, 2, 5]


def test_mixing(spark, docs, plain):
    sizes = Counter()
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in plain:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    got = sm.mix_sources(docs).collect()
    assert len(got) == len(plain)
    for s in names:
        rows = [r for r in got if r.source == s]
        assert abs(rows[0].target - target[s]) < 1e-6 and rows[0].source_size == sizes[s]
        assert sum(r.taken for r in rows) == math.floor(target[s] + 0.5)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert key(map(tuple, sm.mix_sources(docs).collect())) == key(map(tuple, got))
    mixed = sm.mixed_documents(docs)
    assert mixed.columns == docs.columns and sm.mix_sources(docs.limit(0)).count() == 0
    words = Counter()
    for r in mixed.collect():
        words[r.source] += size(r.text)
    longest = max(size(t) for _, t, _ in plain)
    assert all(abs(words[s] - target[s]) <= longest for s in names)


def test_media(docs, plain):
    got = media_columns.media_columns(docs).collect()
    want = []
    for i, t, _ in plain:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert key((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == key(want)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(x) == 1 for x in by.values())
    assert media_columns.media_columns(docs.limit(0)).count() == 0


def test_media_headers_come_from_short_reads(spark, docs):
    from conform.llm.common import new_path

    folder = new_path(spark, "media-test")
    index = media_columns.write_shards(docs, folder)
    heads = media_columns.read_headers(media_columns.members_of(index), folder)
    sizes = index.select("digest", "n_bytes").distinct().join(heads, "digest").collect()
    assert all((r.width, r.bits) == (576, 8) and r.height == max(1, -(-r.n_bytes // 576)) for r in sizes) and len(sizes) == index.select("digest").distinct().count()
    rows = media_columns.media_columns(docs).collect()
    assert all((r.width, r.bits, r.height) == (576, 8, r.payload_bytes // 576) and r.length == r.media_bytes for r in rows)
    assert len({(r.digest, r.shard, r.offset) for r in rows}) == len({r.digest for r in rows})


def test_warc(spark, docs, plain):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.col("text").alias("html"), F.lit(1).alias("kind"), F.lit(2).alias("payload"))
    got = warc_zip.archive_pages(pages).collect()
    best = {}
    for i, t, _ in plain:
        p = (t or "").encode()
        best[p] = max(best.get(p, -1), -1 if i is None else i)
    want = []
    for i, t, _ in plain:
        p = (t or "").encode()
        top = best[p] if best[p] >= 0 else None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == key(want)
    least = warc_zip.archive_pages(pages, least=10**6).collect()
    assert {r.record_type for r in least} == {"response"}
    assert warc_zip.archive_pages(pages.limit(0)).count() == 0


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(3):
            z.writestr(f"m{i}", b"x" * i + b"body")
        z.comment = b"PK note"
    d = warc_zip.ZipDirectory(Bytes(out.getvalue()))
    assert [d.at(*d.range_of(f"m{i}")) for i in range(3)] == [b"x" * i + b"body" for i in range(3)]
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w", zipfile.ZIP_STORED) as z:
        for i in range(66000):  # more than a plain end record can count
            z.writestr(str(i), b"")
        z.writestr("last", b"here")
    d = warc_zip.ZipDirectory(Bytes(many.getvalue()))
    assert len(d.members) == 66001 and d.at(*d.range_of("last")) == b"here"
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    head = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 5, 5, 1, 0) + b"a" + b"hello"
    cd = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(cd), len(head))
    tail = b"PK\x06\x07" + struct.pack("<IQI", 0, len(head) + len(cd), 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    d = warc_zip.ZipDirectory(Bytes(head + cd + end64 + tail))
    assert d.at(*d.range_of("a")) == b"hello"
    with pytest.raises(ValueError):
        warc_zip.ZipDirectory(Bytes(b"nothing"))


def grams(t, n=5):
    w = warc_split(t)
    return {tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))} if w else set()


def warc_split(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def test_ngram_join(spark, docs):
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 500)) for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(120)] = f"z{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(near)))
    rows += [(2000, " ".join(base).upper()), (2001, "one two"), (2002, "One two"), (2003, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("label", F.lit("x")).repartition(3)
    got = nj.jaccard_join(df).collect()
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen]
        want.append((rows[i][0], min((x for x in ids if x is not None), default=None), len(links[i]), len(seen)))
    assert key((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == key(want)
    kept = nj.deduplicated(df)
    assert kept.columns == df.columns
    classes = Counter(r.class_id for r in got if r.doc_id is not None and warc_split(dict_text(rows, r.doc_id)))
    left = Counter(dict((r.doc_id, r.class_id) for r in got)[r.doc_id] for r in kept.collect() if r.doc_id is not None and warc_split(r.text))
    assert set(left) == set(classes) and set(left.values()) == {1}
    assert nj.jaccard_join(df.limit(0)).count() == 0 and nj.deduplicated(df.limit(0)).count() == 0


def dict_text(rows, doc_id):
    return next(t for i, t in rows if i == doc_id)


def test_ngram_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i in range(50) for k in [rng.randrange(60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [grams(t) for _, t in rows]
    want = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(50)) for i in range(50)}
    got = nj.jaccard_join(df).collect()
    assert {r.doc_id: r.n_links for r in got} == want


def test_large_family_at_the_real_block_size(spark):
    """5,000 near copies and a crowd of unlike texts; whether two copies are linked depends on where their words were replaced."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    changed = lambda k, word: " ".join(base[:k] + [word] + base[k + 1 :])
    places = [rng.randrange(60) for _ in range(5000)]
    rows = [(i, changed(k, f"q{i}")) for i, k in enumerate(places)] + [(10_000 + i, " ".join(f"u{rng.randrange(900)}" for _ in range(40))) for i in range(300)]
    a, b = [grams(changed(k, "qa")) for k in range(60)], [grams(changed(k, "qb")) for k in range(60)]
    alike = [[len(x & y) >= 0.8 * len(x | y) - 1e-9 for y in b] for x in a]
    often = Counter(places)
    want = {i: sum(n for p, n in often.items() if alike[k][p]) - alike[k][k] for i, k in enumerate(places)}
    got = {r.doc_id: (r.n_links, r.class_id, r.class_size) for r in nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    lost = [want[i] - got[i][0] for i in want]  # banding has a recall, pairs at the very threshold may miss each other
    assert min(lost) >= 0 and sum(lost) <= 2 * (1 - nj.RECALL) * sum(want.values()) and all(got[i][1:] == (0, 5000) for i in want if want[i])
    assert all(got[i] == (0, i, 1) for i in got if i >= 10_000)


def test_hubs_and_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(nj, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(59, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in nj.components(df).collect()}
    assert got == {i: 0 for i in [*range(60), 200]} | {i: 100 for i in range(100, 141)}
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "k long, v long")
    facts = spark.createDataFrame([(0, "x", True), (1, "y", False)], "k long, f string, hot boolean")
    assert sorted(nj.split_join(rows, facts, ["k"], 1).collect()) == sorted(rows.join(facts.drop("hot"), "k").collect())


def test_bands_reach_their_recall():
    for s in (0.7, 0.8, 0.9):
        bands, rows = nj.choose_bands(s, 0.999)
        assert 1 - (1 - s**rows) ** bands >= 0.999 and bands * rows <= 72


def test_toxicity(spark):
    rng = random.Random(1)
    clean = [f"{a}{b}{c}" for a in "ka mo ri te su".split() for b in "na lo pi".split() for c in "den ras tim".split()]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(clean) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for k in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumblor", "snarfely", "zqyx" + rng.choice(["ab", "cd", "ef", "gh", "ij"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "kanaden"), (5002, " ".join(clean[:20]) + " grumblr snarfley grumblor"), (5003, "x " * 50000), (5004, " ".join(clean))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("toxic", F.lit(3))
    lab = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.score_toxicity(df, lab).collect()}
    wrong = [i for i, y in labels if got[i].predicted != y]
    assert len(wrong) <= 6
    assert got[5002].predicted == 1 and got[5004].predicted == got[5000].predicted == got[5001].predicted == got[5003].predicted == 0
    assert got[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    assert tx.score_toxicity(df.limit(0), lab).count() == 0
    assert {r.predicted for r in tx.score_toxicity(df, lab.limit(0)).collect()} == {0}


def test_automaton_finds_what_edit_distance_finds():
    trie = tx.Trie()
    for term in ("idiot", "worthless", "pathetic"):
        trie.add(term, False)
    trie.add("lowei", True)

    def distance(a, b):
        d = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(4)
    for _ in range(3000):
        term = rng.choice(("idiot", "worthless", "pathetic"))
        w = list(term)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "t", "e"])
        w = "".join(w)
        best = min(((distance(w, t), t) for t in ("idiot", "worthless", "pathetic") if distance(w, t) <= tx.edits_allowed(t)), default=None)
        found = trie.find(w)
        assert (found is None) == (best is None), w
        assert found is None or found[1] == best[0], w
    assert trie.find("loweiheit") == (3, 0)


def test_misspelled_inflections_are_found():
    stems = ("idio", "lowei", "schurk")
    trie = tx.Trie()
    for s in stems:
        trie.add(s, True)

    def beginning(w, s):
        """The least number of edits that makes a beginning of ``w`` the stem."""
        d = [[i + j if 0 in (i, j) else 0 for j in range(len(s) + 1)] for i in range(len(w) + 1)]
        for i in range(1, len(w) + 1):
            for j in range(1, len(s) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (w[i - 1] != s[j - 1]))
                if i > 1 and j > 1 and w[i - 1] == s[j - 2] and w[i - 2] == s[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return min(row[-1] for row in d)

    rng = random.Random(5)
    for _ in range(3000):
        w = list(rng.choice(stems) + rng.choice(["tic", "ten", "heit", ""]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i", "e"])
        w = "".join(w)
        best = min((beginning(w, s) for s in stems if beginning(w, s) <= 1 and len(w) >= len(s)), default=None)
        found = trie.find(w)
        assert (found and found[1]) == best, (w, found, best)
    assert trie.find("idoitic") == (0, 1) and trie.find("idi") is None

    terms = tx.choose_terms({"4idio": 100, "widiot": 50, "widiotic": 40, "wother": 9})
    assert terms == [("idio", True), ("other", False), ("idiot", False), ("idiotic", False)]
    both = tx.Trie()
    for term in terms:
        both.add(*term)
    assert both.find("idoitic") == (3, 1) and both.find("idiotism") == (0, 0)


def test_misspelled_inflections_score(spark):
    rng = random.Random(6)
    clean = [f"{a}{b}{c}" for a in "ka mo ri te su".split() for b in "na lo pi".split() for c in "den ras tim".split()]
    rows = [(i, " ".join([rng.choice(clean) for _ in range(30)] + (["zqyx" + rng.choice(["abe", "cde", "efe", "ghe", "ije"])] * 3 if i % 4 == 0 else []))) for i in range(800)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    rows += [(5000, " ".join([*clean[:20], "zqxyabe zyqxcde zqyyefe"])), (5001, " ".join(clean[:20]))]
    got = {r.doc_id: r.predicted for r in tx.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert (got[5000], got[5001]) == (1, 0)


def test_quotation_counts_apart():
    trie = tx.Trie()
    trie.add("idiot", False)
    scorer = tx.Scorer(trie, {(0, 0): 5.0}, reports=frozenset({"said"}))
    abuse, quoted = scorer.features("you are an idiot my friend"), scorer.features('she said "idiot" to him')
    assert abuse[0] > 0 == abuse[4] and quoted[4] > 0 == quoted[0]


def test_language_model(spark):
    rng = random.Random(8)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(rng.randint(5, 80)))) for i in range(700)]
    rows += [(900, None), (901, ""), (None, "A1 a1"), (902, "q" * 200 + " a1"), (903, "q" * 200), (904, "never seen words"), (905, "a1 " * 4000), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("known", F.lit(1)).withColumn("rid", F.lit("x")).repartition(2)
    learn = ~lm.held_out("doc_id", 7, 2)
    got = lm.score_documents(df, learn).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    low = lambda t: [w.translate(lm.CAPITALS) for w in (t or "").encode().split()]
    c, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(low(t))
            ends += 1
    total, kinds = sum(c.values()) + ends, len(c) + 1
    want = {}
    for i, t in rows:
        w = low(t)
        want[i] = (len(w) + 1, sum(c[x] > 0 for x in w) + 1, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and abs(r.base_score - want[r.doc_id][2]) < 1e-6 and r.train_tokens == total and r.score < 0
    inside = [r for r in got if r.doc_id is not None and r.doc_id < 700 and held(r.doc_id)]
    assert sum(r.score for r in inside) > sum(r.base_score for r in inside)
    assert len({round(r.score, 6) for r in got if r.doc_id == 3}) == 1
    assert lm.score_documents(df.limit(0), learn).count() == 0


def test_gates_lie_in_one_piece_and_states_are_right():
    rng = np.random.default_rng(4)
    p = {"G": rng.normal(0, 1, (9, 3 * lm.HIDDEN)).astype(np.float32), "U": rng.normal(0, 1, (lm.HIDDEN, 3 * lm.HIDDEN)).astype(np.float32)}
    x, first, k = rng.integers(0, 9, (7, 5)), np.zeros((7, 5), bool), lm.HIDDEN
    first[0, :3] = first[4, 1] = True
    start = rng.normal(0, 1, (5, k)).astype(np.float32)
    hs, gates, us = lm.recur(p, x, [np.flatnonzero(row) for row in first], start)
    assert all(part.flags.c_contiguous for part in [*gates, us, *lm.by_gate(p["U"])])  # columns of a wider array cost several times the seconds
    h = start.astype(np.float64)
    for t in range(7):
        h = h * ~first[t][:, None]
        u, g = h @ p["U"], p["G"][x[t]]
        z, r = (1 / (1 + np.exp(g[:, a : a + k] + u[:, a : a + k])) for a in (0, k))
        n = np.tanh(g[:, 2 * k :] + r * u[:, 2 * k :])
        assert np.abs(hs[t] - h).max() < 1e-5 and all(np.abs(a - b).max() < 1e-5 for a, b in zip(gates[:, t], (z, r, n)))
        h = n + z * (h - n)
    assert np.abs(hs[7] - h).max() < 1e-5


def test_words_outside_the_head_are_found_in_place(monkeypatch):
    asked = []
    monkeypatch.setattr(lm, "shape_of", lambda w, f=lm.shape_of: asked.append(w) or f(w))

    class Two:
        index, token = {b"": 0, b"a": 1, lm.key_of(b"l" * 90): 2}, np.array([0, 1, lm.NET_WORDS + 5], np.int32)

    e, symbols, lengths, outside, places = lm.indexed(Two, ["a B a", None, "", "L" * 90 + " c", "a"])
    assert e.tolist() == [1, -1, 1, 0, 0, 0, 2, -1, 0, 1, 0] and lengths.tolist() == [4, 1, 1, 3, 2]
    assert outside == asked == [b"b", b"c"] and places.tolist() == [1, 7] and symbols[7] == lm.NET_WORDS + lm.shape_of(b"c") and symbols[6] == lm.NET_WORDS + 5


def test_every_window_reaches_the_weights():
    class Flat:
        net_counts, shape_counts = np.ones(lm.NET_WORDS), np.ones(lm.SHAPES)

    start = lm.initial(Flat)
    tokens = np.repeat(np.arange(1, 7), lm.WINDOW)  # a symbol of its own in each of six windows
    trainer = lm.Trainer({k: v.copy() for k, v in start.items()}, {k: np.zeros_like(v) for k, v in start.items()})
    trainer.run(tokens, np.array([len(tokens)]))
    assert (trainer.p["G"][1:7] != start["G"][1:7]).any(axis=1).all()
    assert (trainer.squares["W"][1:7] > 0).any(axis=1).all()
    assert trainer.seen == len(tokens)


def test_gradients_are_right():
    rng = np.random.default_rng(0)

    class Flat:
        net_counts, shape_counts = np.ones(lm.NET_WORDS), np.ones(lm.SHAPES)

    p = lm.initial(Flat)
    x = rng.integers(0, lm.NET_WORDS + lm.SHAPES, (6, 3))
    first = np.zeros(x.shape, dtype=bool)
    first[0] = first[3, 1] = True

    class Probe(lm.Trainer):
        def step(self, g, rows, dg, n):
            self.got = g, rows, dg

    def loss(q):
        total, h = 0.0, np.zeros((3, lm.HIDDEN))
        for t in range(6):
            h = h * (~first[t])[:, None]
            total -= lm.output_scores(q, h, x[t])[0].sum()
            u, gx, k = h @ q["U"], q["G"][x[t]], lm.HIDDEN
            zr = 1 / (1 + np.exp(gx[:, : 2 * k] + u[:, : 2 * k]))
            n = np.tanh(gx[:, 2 * k :] + zr[:, k:] * u[:, 2 * k :])
            h = n + zr[:, :k] * (h - n)
        return total

    probe = Probe(p, {k: np.zeros_like(v) for k, v in p.items()})
    probe.window(x, first, np.zeros((3, lm.HIDDEN), lm.f32))
    g, rows, dg = probe.got
    wide = {k: v.astype(np.float64) for k, v in p.items()}
    for name in ("U", "C", "c", "W", "w", "G"):
        for _ in range(6):
            at = (int(rng.choice(x.ravel())) if name in "GWw" and name != "U" else int(rng.integers(wide[name].shape[0])),)
            at += tuple(int(rng.integers(s)) for s in wide[name].shape[1:])
            up, down = ({k: v.copy() for k, v in wide.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            numeric = (loss(up) - loss(down)) / 2e-5
            own = dg[rows == at[0]][:, at[1]].sum() if name == "G" else g[name][at]
            assert abs(numeric - own) < 1e-2 * max(1, abs(numeric)), (name, at, numeric, own)


def brute_log_probability(p, symbols):
    """Log probability of every symbol of one document, a step at a time, from the model's definition."""
    h, out = np.zeros(lm.HIDDEN), []
    k = lm.HIDDEN
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for y in symbols:
        cls = y // lm.CLASS_WORDS
        rows = slice(cls * lm.CLASS_WORDS, (cls + 1) * lm.CLASS_WORDS)
        log = np.log(softmax(h @ p["C"] + p["c"])[cls]) + np.log(softmax(p["W"][rows] @ h + p["w"][rows])[y - cls * lm.CLASS_WORDS])
        out.append(log)
        g, u = p["G"][y].astype(float), h @ p["U"]
        z, r = (1 / (1 + np.exp(g[a : a + k] + u[a : a + k])) for a in (0, k))
        n = np.tanh(g[2 * k :] + r * u[2 * k :])
        h = n + z * (h - n)
    return np.array(out)


def test_language_model_equals_a_plain_forward_pass():
    class Flat:
        net_counts, shape_counts = np.arange(lm.NET_WORDS, 0, -1), np.ones(lm.SHAPES)

    rng = np.random.default_rng(8)
    p = {name: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for name, v in lm.initial(Flat).items()}
    docs = [rng.integers(0, lm.NET_WORDS + lm.SHAPES, n) for n in (1, 2, 700, 23, 24, 25, 0 + 48, 3)]
    lengths = np.array([len(d) for d in docs])
    got = lm.score_tokens(p, np.concatenate(docs).astype(np.int32), lengths)
    want = np.concatenate([brute_log_probability(p, d) for d in docs])
    assert np.abs(got - want).max() < 1e-3
    # from any state, the symbols' probabilities make one
    every = np.arange(lm.NET_WORDS + lm.SHAPES, dtype=np.int32)
    state = np.repeat(rng.normal(0, 0.5, (1, lm.HIDDEN)).astype(np.float32), len(every), axis=0)
    assert abs(np.exp(lm.output_scores(p, state, every)[0]).sum() - 1) < 1e-3


def test_lanes_hold_every_token_once_and_need_no_more_memory_than_a_window():
    lengths = np.array([1_000_000, 3, 1, 40, 700, 700, 2])
    seen, firsts, biggest = [], 0, 0
    for at, first in lm.side_by_side(lengths, 4, 24):
        seen.append(at[at >= 0])
        firsts += int(first.sum())
        biggest = max(biggest, at.size)
    seen = np.concatenate(seen)
    assert len(seen) == lengths.sum() == len(np.unique(seen)) and firsts == len(lengths) and biggest <= 96


def test_seen_and_unseen_words_share_one_mass(spark):
    words = [f"w{i % 50}{'abcdefgh'[i % 8]}e" for i in range(400)] + [f"x{i}e" for i in range(3000)] + [f"y{i}e" for i in range(1500)] * 2
    texts = spark.createDataFrame([(" ".join(words[i::7]),) for i in range(7)], "text string")
    counts = lm.word_counts(texts)
    assert {r.word: r.c for r in counts.collect()} == Counter(words)
    own = lm.build_lexicon(counts, 7)
    for shape in np.flatnonzero(own.shape_counts > 0):
        seen = np.exp(own.within[(own.token == lm.NET_WORDS + shape)]).sum()
        assert abs(seen + np.exp(own.unseen()[shape]) * own.shape_unseen[shape] - 1) < 1e-6
    assert lm.shape_of(b"keit,") == lm.shape_of(b"heit") and own.shape_unseen[lm.shape_of(b"x1e")] > 1


def test_sql_of_sharding_and_archives(spark, docs):
    import duckdb

    odd = [(7, "copy"), (7, "copy"), (3, "copy"), (None, "copy"), (None, None), (None, None), (9, ""), (11, "é  ß" * 50)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, docs.select("doc_id", "text").schema))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") > 3, F.concat(F.lit("http://a/"), F.col("doc_id"))).alias("url"), F.col("text").alias("html"))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("pages", pages.toArrow())
    for got, sql in ((rendezvous.shard_documents(docs), rendezvous.sql()), (warc_zip.archive_pages(pages), warc_zip.SQL)):
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(got.columns)
        assert key(tuple(r) for r in got.select(*names).collect()) == key(found.fetchall())
