"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash-random number u in (0, 1); a key goes to the shard with the largest
``weight / -ln(u)``. A shard that is added takes records only into itself, one that is removed only gives its own away, and nothing but
key, weights and the shards' names decides. Slots number a shard's records without gaps: records are dealt into
narrow ranges of a second hash (md5, as every engine has it), ranges are counted, and a record's slot is its rank in its range plus the counts of
the ranges before it, so no shard is ever sorted in one task.

Defined cases: a null key counts as the empty text, so all such records share one shard (the law is that the key
decides); a null text has no bytes; repeated rows share a shard and have slots of their own; no row gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.llm.common import id_text, materialize, text_of

#: Hexadecimal digits of an md5 digest that make a hash-random number; a double holds them exactly.
DIGITS = 13
#: Records of a range of slots, about.
RANGE_ROWS = 2048


def uniform(text: Column) -> Column:
    """A hash-random number in (0, 1) of a text."""
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, of a key given as text; equal scores go to the lowest shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.log(uniform(F.concat(key, F.lit(f":{i}"))))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps, by a hash of the ``order`` columns. ``rows`` must be a written table."""
    n = max(1, rows.count())
    shards = max(1, rows.select(shard).distinct().count())
    ranges = max(1, min(1 << 17, -(-n // (RANGE_ROWS * shards))))
    at = uniform(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    names = rows.columns
    alike = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__m"))  # alike rows may have each other's places, so they are counted before the shuffle and numbered as one
    dealt = materialize(alike.withColumns({"__at": at, "__range": F.floor(at * F.lit(ranges - 1e-6)).cast("int")}), "shard-ranges")
    counts = dealt.groupBy(shard, "__range").agg(F.sum("__m").alias("__n"))
    before = counts.select(shard, "__range", F.coalesce(F.sum("__n").over(Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("__m").over(Window.partitionBy(shard, "__range").orderBy("__at", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__m")
    placed = dealt.withColumn("__within", within).join(before, [shard, "__range"]).withColumn("__first", F.col("__before") + F.col("__within"))
    most = dealt.agg(F.max("__m")).first()[0] or 1
    if most > RANGE_ROWS:  # blocks of alike rows first, so that many tasks write them
        placed = placed.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__m") - 1) / RANGE_ROWS)))).repartition(shard, "__range", "__block")
    else:
        placed = placed.withColumn("__block", F.lit(0).cast("long"))
    start = F.col("__block") * RANGE_ROWS
    each = F.explode(F.sequence(start, F.least(F.col("__m"), start + RANGE_ROWS) - 1))
    return placed.withColumn("__i", each).select(*names, (F.col("__first") + F.col("__i")).alias(slot))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: float = 1.0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; the last with one more shard of weight ``grown``. Texts are read once and never shuffled."""
    raw = F.encode(text_of(text), "UTF-8")
    key = id_text(id_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.octet_length(text_of(text))).cast("long").alias("__bytes"),
        F.crc32(raw).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, grown]).alias("grown_shard"),
    )
    rows = materialize(rows.select("doc_id", (F.col("__bytes") + 1).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard"), "shards")
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sql(shards: int = 8) -> str:
    """The rows of :func:`shard_documents` with equal weights, for DuckDB; the checksum goes byte by byte through a table made from its polynomial."""
    u = f"(('0x' || substr(md5({{}}), 1, {DIGITS}))::BIGINT + 0.5::DOUBLE) / {16**DIGITS}::DOUBLE"
    score = "list_transform(range(0, {}), lambda i: 1.0::DOUBLE / -ln(" + u.format("key || ':' || i") + "))"
    first = "list_position({0}, list_max({0}))::INTEGER - 1"
    return f"""
WITH steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) AS r(i)),
read AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, encode(coalesce(text, '')) AS raw FROM documents),
sized AS (
  SELECT doc_id, key, (octet_length(raw) + 1)::BIGINT AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM read, steps),
dealt AS (SELECT *, {first.format(score.format(shards))} AS shard, {first.format(score.format(shards + 1))} AS grown_shard FROM sized),
ranked AS (SELECT *, {u.format("key || ':' || text_crc32 || ':' || size")} AS place FROM dealt)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM ranked
"""
