"""Merkle manifest of a table: a digest of every row, of every source and of the whole, with proofs that show which rows still stand.

A row's leaf is the SHA-256 of its fields; 16 consecutive nodes make a parent, until one is left for each source (its subroot), and the subroots likewise
make the root. Levels are kept as strings: every aligned block of 256 nodes is one row that holds the digests of a level one behind the other as
hexadecimal text, 64 characters each. Parents are hashes of substrings of 1,024 characters, a node's siblings are the substrings beside it in its run, and the one digest
that a block leaves is a node of the next, shorter table of blocks. So a table of n rows takes log256(n) rounds, each of one shuffle of digests; texts
are read once and never shuffled. No task holds more than one range of the order at a time or one block, whatever share of the rows a source has.

Defined cases: a null field counts as ``-``; rows without a source make a source of their own that comes first; rows without an id come first in their
source; rows of one id stand by their leaves, and rows alike in all have proofs of their own places; only rows with an id are ever tampered with; no row gives
no row; other columns are ignored. A lone leaf is its source's subroot, a lone subroot the root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.llm.common import materialize

#: Children of a node, characters of a digest, levels of a block, nodes of a block.
WIDTH, DIGEST, LEVELS = 16, 64, 2
BLOCK, RUN = WIDTH**LEVELS, WIDTH * DIGEST
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a table of offsets up to which it is broadcast (about 60 bytes each).
FEW_OFFSETS = 200_000
#: What a step on a path is: the digests left and right of a node in its run.
STEPS = "array<struct<left:string,right:string>>"


def field(col: Column) -> Column:
    """A field as it enters a leaf: its bytes' number and its text, so that no two rows of fields give one text."""
    return F.coalesce(F.concat(F.octet_length(col.cast("string")).cast("string"), F.lit(":"), col.cast("string")), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the row's place in its group from 0, and ``n``, the group's rows.

    Rows are dealt out by ranges of (group, order) and written in that order, so a row's place is its place in the written range, less the place of
    its group's first row there, plus the group's rows in earlier ranges. Equal rows may stand in any order, so a random number parts them over ranges.
    """
    salted = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    sorted_ = salted.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *order, "__salt")]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (group, *order)])
    dealt = materialize(sorted_.drop("__salt").withColumn("__at", F.monotonically_increasing_id()), "merkle-order")
    dealt = dealt.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    counts = dealt.groupBy(group, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(group)
    before = F.sum("__rows").over(whole.orderBy("__range")) - F.col("__rows")  # a window over a group's ranges, not over its rows
    offsets = materialize(counts.select(group, "__range", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n")), "merkle-offsets")
    few = offsets.count() <= FEW_OFFSETS
    return dealt.join(F.broadcast(offsets) if few else offsets, [group, "__range"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def blocks(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Aligned blocks of nodes (``grp, pos, n, digest``): ``grp, block, n, rows, level0, level1, top``. A block holds at most 256 nodes."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    held = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(rows.alias("rows"))
    held = held.withColumn("level0", F.array_join(F.transform("rows", lambda r: r["digest"]), ""))
    runs = F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / WIDTH).cast("int"))
    held = held.withColumn("level1", F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(F.col("level0"), i * RUN + 1, F.lit(RUN)), 256)), ""))
    return held.withColumn("top", F.when(F.col("n") == 1, F.col("level0")).when(F.col("n") <= WIDTH, F.col("level1")).otherwise(F.sha2("level1", 256)))


def step(level: Column, i: Column) -> Column:
    """The digests beside node ``i`` of a level in its run of 16."""
    start = F.floor(i / WIDTH).cast("int") * RUN
    own = i * DIGEST
    return F.struct(F.substring(level, start + 1, own - start).alias("left"), F.substring(level, own + DIGEST + 1, start + RUN - own - DIGEST).alias("right"))


def steps() -> Column:
    """The steps that node ``__i`` of a block has inside the block: none if it is alone in its group, one in a group of one run, else two."""
    i = F.col("__i")
    first, second = step(F.col("level0"), i), step(F.col("level1"), F.floor(i / WIDTH).cast("int"))
    return F.when(F.col("n") == 1, F.array().cast(STEPS)).when(F.col("n") <= WIDTH, F.array(first)).otherwise(F.array(first, second)).cast(STEPS)


def climb(nodes: DataFrame, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and ``grp, top``: the one node that each group is left with."""
    tables: list[DataFrame] = []
    while True:
        tables.append(materialize(blocks(nodes, payload if not tables else ()), "merkle-blocks"))
        tops = tables[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
        most = tables[-1].agg(F.max("n")).first()[0] or 0
        if most <= BLOCK:
            return tables, tops.select("grp", F.col("digest").alias("top"))
        nodes = tops


def descend(tables: Sequence[DataFrame], above: DataFrame, payload: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """From each group's top (``grp, path`` and ``keep``) down to its nodes: ``grp, pos, digest, payload..., path``, the steps from a node upwards.

    Every join is by (group, block), so at most 256 rows share a key."""
    above = above.select("grp", F.lit(0).cast("long").alias("block"), "path", *keep)
    for table in reversed(tables):
        last = table is tables[0]
        found = table.join(above.withColumnRenamed("path", "__above"), ["grp", "block"])
        found = found.select("grp", "n", "level0", "level1", "__above", *keep, F.posexplode("rows").alias("__i", "__row"))
        own = F.concat(steps(), F.col("__above")).alias("path")
        above = found.select("grp", F.col("__row.pos").alias("pos" if last else "block"), *([F.col("__row.digest").alias("digest"), *[F.col(f"__row.{c}").alias(c) for c in payload]] if last else []), own, *keep)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame) -> DataFrame:
    """``doc_id, leaf, changed, subroot, root, path`` of rows ``doc_id, source, leaf`` and, where a row was altered since, ``changed``, its leaf now."""
    named = rows.select("doc_id", "leaf", "changed", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("grp"))
    placed = positions(named.withColumnRenamed("leaf", "digest"), "grp", ["doc_id", "digest"])
    tables, subroots = climb(placed, ["doc_id", "changed"])
    sources = positions(subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), F.col("top").alias("digest")), "all", ["name"])
    upper, root = climb(sources.withColumnRenamed("all", "grp"), ["name"])
    tops = descend(upper, root.select("grp", F.array().cast(STEPS).alias("path"), F.col("top").alias("root")), ["name"], ["root"])
    tops = materialize(tops.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"), "merkle-tops")
    return descend(tables, tops, ["doc_id", "changed"], ["subroot", "root"]).withColumnRenamed("digest", "leaf")


def tampered(id_col: Column) -> Column:
    """Which rows of the proof's trial are altered."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the manifest of ``documents``, and its proofs held against rows of which some have lost their capitals."""
    whole = digest(*[field(F.col(c)) for c in FIELDS])
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = digest(*[field(F.col(c)) for c in FIELDS[:-1]], field(F.translate(F.col("text").cast("string"), capitals, capitals.lower())))
    rows = docs.select("doc_id", "source", whole.alias("leaf"), F.when(tampered(F.col("doc_id")), lower).alias("changed"))
    found = manifest(rows).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql(levels: int = 8, source_levels: int = 4) -> str:
    """The rows of :func:`dataset_manifest` for DuckDB, for sources of up to 16^levels rows; the checksum goes byte by byte through a table made from its polynomial."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, FIELDS[:-1]), part(text)]) + ")"
    out = [
        "steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) AS r(i))",
        f"read AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('translate(text, upper(a), a)')} AS lowered, encode(CAST(doc_id AS VARCHAR)) AS raw FROM documents, (SELECT 'abcdefghijklmnopqrstuvwxyz' AS a))",
        "checked AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 5 = 0 AS hit FROM read, steps)",
        "d0 AS (SELECT doc_id, source, leaf, CASE WHEN hit THEN lowered ELSE leaf END AS now, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM checked)",
        "a0 AS (SELECT source AS grp, pos, leaf AS digest FROM d0)",
    ]

    def tree(name: str, n: int) -> None:
        for i in range(n):
            out.append(f"{name}m{i} AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{i})")
            out.append(
                f"{name}{i + 1} AS (SELECT grp, pos // 16 AS pos, CASE WHEN n = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}m{i} GROUP BY grp, pos // 16, n)"
            )
            side = lambda frame: f"CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(digest, '') OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN {frame}), '') END"
            out.append(f"{name}s{i} AS (SELECT grp, pos, n > 1 AS more, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}m{i})")

    tree("a", levels)
    out.append(f"b0 AS (SELECT 1 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, digest, grp AS source FROM a{levels})")
    tree("b", source_levels)
    out.append(f"c0 AS (SELECT d0.*, b0.pos AS spos, b0.digest AS subroot, b{source_levels}.digest AS root, '' AS proof, d0.now AS h FROM d0 JOIN b0 ON d0.source IS NOT DISTINCT FROM b0.source, b{source_levels})")
    k = 0
    for name, n, at, on in (("a", levels, "pos", "c.source IS NOT DISTINCT FROM s.grp"), ("b", source_levels, "spos", "s.grp = 1")):
        for i in range(n):
            out.append(f"c{k + 1} AS (SELECT c.* REPLACE (proof || s.l || s.r AS proof, CASE WHEN s.more THEN sha256(s.l || h || s.r) ELSE h END AS h) FROM c{k} c JOIN {name}s{i} s ON {on} AND c.{at} // {16**i} = s.pos)")
            k += 1
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM c{k}"
