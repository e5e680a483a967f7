"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys; each source is cut into key ranges of about ``RANGE_ROWS`` documents, so the hottest source is spread like
any other. Rows alike in source, key, id and size are counted as one row first, so repeated rows and rows without an id do not fill a range. Ranges are summed, the sums are added up along a source, and rows add up within their range: a distributed
prefix sum of words in key order. A source's budget takes whole epochs first and then the documents up to the exact
word at which the prefix sum meets the rest of the budget.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words; a target stops at
``most`` times its source, and what is over is shared again by weight until no target is above its limit. With the
sources in the order of limit per weight, the share per weight is ``(all - limits before) / weights from here``, and
its largest value is the final one; a source gets that times its weight, or its limit.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own; rows that tie in
key, id and size are alike, so it does not matter which of them is cut; no row gives no row; other columns are ignored.
The table of sources (a row for each) passes through one task; everything that has a row for each document is dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.llm.common import WORD, free_names, id_text, materialize

#: Documents of a key range, about.
RANGE_ROWS = 2048
#: Hexadecimal digits of the md5 digest that make the hash-random key.
DIGITS = 13
#: Sources up to which their table is broadcast.
FEW_SOURCES = 50_000
#: Copies of a row that a task makes in one go.
COPIES = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mixing_key(id_col: str, seed: str = "") -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), id_text(id_col))), 1, DIGITS), 16, 10).cast("long")


def source_targets(sized: DataFrame, most: int = 3) -> DataFrame:
    """A row for each source of ``(source, size)``: ``source, source_rows, source_size, weight, target``."""
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    ranked = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    limits = ranked.withColumn("limit", F.col("source_size") * F.lit(most))
    line = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    shares = limits.withColumn("share", (F.sum("source_size").over(every) - before).cast("double") / ahead)
    return shares.select("source", "source_rows", "source_size", "weight", F.least(F.col("limit").cast("double"), F.max("share").over(every) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, most: int = 3, seed: str = "", text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, size, mix_key, source_size, target, epochs, part, taken``: ``taken = epochs * size + part`` words of each document."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), mixing_key(id_col, seed).alias("mix_key")), "mix-sizes")
    targets = materialize(source_targets(sized, most), "mix-targets")
    few = targets.count() <= FEW_SOURCES
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = targets.select(
        F.col("source").alias("__source"), "source_size", "target", F.ceil(F.col("source_rows") / RANGE_ROWS).alias("__ranges"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"), budget.alias("__budget"),
    )
    alike = materialize(sized.groupBy("source", "mix_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("__n")), "mix-alike")
    rows = alike.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.withColumn("__range", F.floor(F.col("mix_key") / float(16**DIGITS) * F.col("__ranges")))
    sums = rows.groupBy("__source", "__range").agg(F.sum(F.col("size") * F.col("__n")).alias("__sum"))
    before = sums.select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__source", "__range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(F.col("size") * F.col("__n")).over(within), F.lit(0)))
    rows = rows.join(before, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    # copies again: blocks of a bounded number of them first, so that many copies are made by many tasks
    several = alike.agg(F.max("__n")).first()[0]
    if several and several > COPIES:
        rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES)))).repartition("__source", "__range", "__block")
    else:
        rows = rows.withColumn("__block", F.lit(0).cast("long"))
    last = F.least(F.col("__n"), (F.col("__block") + 1) * COPIES) - 1
    rows = rows.withColumn("__i", F.explode(F.sequence(F.col("__block") * COPIES, last)))
    rest = F.col("__budget") - F.col("epochs") * F.col("source_size") - F.col("__before") - F.col("__within") - F.col("__i") * F.col("size")
    part = F.greatest(F.lit(0), F.least(rest, F.col("size"))).cast("long")
    out = rows.withColumn("part", part)
    return out.select("doc_id", "source", "size", "mix_key", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, most: int = 3, seed: str = "", text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix as documents: every row as often as its epochs say, once more up to its source's cut. Texts are not shuffled.

    Rows alike in source, id and size stay together at the cut. A document across which the cut goes is taken whole if at least half of it lies before the cut. A document without words
    follows its key like any other.
    """
    mix = mix_sources(docs, most, seed, text, id_col, source)
    key, of, epochs, cut, times, copy = free_names(docs, "__key", "__source", "__epochs", "__cut", "__times", "__copy")
    cuts = materialize(mix.groupBy("source").agg(F.max("epochs").alias(epochs), F.max(F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), F.col("mix_key"))).alias(cut)).withColumnRenamed("source", of), "mix-cuts")
    few = cuts.count() <= FEW_SOURCES
    rows = docs.withColumn(key, mixing_key(id_col, seed)).join(F.broadcast(cuts) if few else cuts, F.col(source).eqNullSafe(F.col(of)))
    rows = rows.withColumn(times, (F.col(epochs) + F.when(F.col(key) <= F.col(cut), 1).otherwise(0)).cast("int")).filter(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


#: The mix in DuckDB's SQL.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}))::BIGINT AS k FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS lim FROM sources),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM ranked),
targets AS (SELECT source, source_size, least(lim::DOUBLE, max(share) OVER () * weight) AS target FROM shares),
plan AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
rows AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size
    - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(rest, size)) AS BIGINT) AS taken FROM rows
"""
