"""Document fingerprints: a canonical exact digest, with DataFrame functions only.

Canonical text: Unicode normal form KC (by the ICU class that Spark carries, called as a SQL function), upper then lower case, every run of white
space one space, none at the ends. Two 64-bit xxhash values of it, of different seeds, group the documents; inside a
group of equal hashes the canonical bytes are compared, and different texts that share both hashes get numbers of
their own. Equal fingerprints therefore mean equal canonical texts.

Defined cases: a null text counts as empty; the empty text has a fingerprint like any other; documents without an id stand
after all others, by the hash of their text; ids must be numbers; rows with equal id and text are alike; no row gives no row;
other columns are ignored. Texts are never cut. The fingerprint compares whole texts, so likeness is 1 or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.llm.common import materialize, text_of

#: Rows of a range of the order by id, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 512, 1 << 17
#: Bytes of texts of a task of the order, about.
TASK_BYTES = 32 << 20
#: First cuts of the order, from quantiles of the ids.
CUTS = 64
#: Groups of equal hashes up to which their table is broadcast (16 bytes each).
FEW_GROUPS = 500_000
SEED = 0x5EED


def normal_form(col: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))


def canonical(col: Column) -> Column:
    """Normal form, folded case, folded white space; normalised again, as folding may leave the normal form.

    White space is folded between upper and lower case, as Spark would take ``lower(upper(x))`` for ``lower(x)``.
    """
    folded = F.lower(F.regexp_replace(F.upper(normal_form(col)), r"[\s\p{Z}\x1C-\x1F\x85]+", " "))
    return F.trim(normal_form(folded))


def wide_hash(col: Column) -> Column:
    """128 bits as 32 hexadecimal digits; the second half starts from another seed."""
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(col), half(F.lit(SEED), col))


def clashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Compare bytes inside equal buckets: ``hash, digest, suffix`` of texts that share a hash without being equal; usually no row."""
    spark = docs.sparkSession
    hashes = materialize(docs.select(canonical(text_of(text)).alias("canon")).select(wide_hash(F.col("canon")).alias("hash")), "fingerprint-hashes")
    several = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    several = materialize(several, "fingerprint-buckets")
    few = several.count() <= FEW_GROUPS
    texts = docs.select(canonical(text_of(text)).alias("canon")).withColumn("hash", wide_hash(F.col("canon")))
    members = texts.join(F.broadcast(several) if few else several, "hash", "left_semi")
    ends = members.groupBy("hash").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    found = materialize(ends.filter("least <> most").select("hash"), "fingerprint-clashes")
    if found.isEmpty():
        return spark.createDataFrame([], "hash string, digest string, suffix int")
    digests = texts.join(found, "hash", "left_semi").select("hash", F.sha2("canon", 256).alias("digest")).distinct()
    return materialize(digests.withColumn("suffix", F.row_number().over(Window.partitionBy("hash").orderBy("digest"))), "fingerprint-suffixes")


def with_fingerprint(rows: DataFrame, text: str, name: str, apart: DataFrame | None) -> DataFrame:
    """Add the fingerprint of a text column."""
    if apart is None:
        return rows.withColumn(name, wide_hash(canonical(F.col(text))))
    rows = rows.withColumn("__canon", canonical(F.col(text))).withColumns({"__hash": wide_hash(F.col("__canon")), "__digest": F.sha2("__canon", 256)})
    rows = rows.join(apart.withColumnsRenamed({"hash": "__hash", "digest": "__digest", "suffix": "__suffix"}), ["__hash", "__digest"], "left")
    return rows.withColumn(name, F.concat_ws("-", "__hash", "__suffix")).drop("__canon", "__hash", "__digest", "__suffix")


def compared(docs: DataFrame, text: str = "text") -> DataFrame | None:
    """The clashes of a table, None if there are none."""
    found = clashes(docs, text)
    return None if found.isEmpty() else found


def fingerprint_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint`` of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("__text"))
    return with_fingerprint(rows, "__text", "fingerprint", compared(docs, text)).select("doc_id", "fingerprint")


def fingerprint_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``fingerprint, copies, keeper`` (the least id) of every group of equal documents; groups are added up before the shuffle."""
    return fingerprint_documents(docs, text, id_col).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keeper"))


def _bucket(cuts: list[float], parts: int) -> Column:
    """The range of the order by id, rising with it: a search among the quantiles, then even parts between two of them."""

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            a, b = cuts[low], cuts[high]
            inside = F.floor((F.col("doc_id").cast("double") - a) / ((b - a) or 1.0) * parts)
            return (F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside)) + low * parts).cast("long")
        middle = (low + high) // 2
        return F.when(F.col("doc_id").cast("double") < cuts[middle], search(low, middle)).otherwise(search(middle, high))

    without = F.shiftright(F.col("__th"), 48).cast("long") - 32768 - 1
    return F.when(F.col("doc_id").isNull(), without).otherwise(search(0, len(cuts) - 1))


def next_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text, next_text`` (and fingerprint columns that ``docs`` has): the text of the next document by descending id; after the last comes the first.

    The order is cut into ranges by quantiles of the ids. The first row of each range is also sent to the range before it, so every range
    holds all that its rows need: one shuffle of the texts, no range in one task with another.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"), *[c for c in ("fingerprint",) if c in docs.columns]).withColumn("__th", F.xxhash64("text"))
    ids = docs.select(F.col(id_col).cast("double").alias("d"), F.octet_length(text_of(text)).cast("long").alias("b"))
    n, total, cuts = ids.agg(F.count(F.lit(1)), F.sum("b"), F.percentile_approx("d", [i / CUTS for i in range(CUTS + 1)], 2000)).first()
    tasks = max(1, min(n // RANGE_ROWS + 1, -(-(total or 0) // TASK_BYTES)))
    cuts = sorted(set(cuts or [])) or [0.0]
    cuts = [*cuts, cuts[0] + 1.0] if len(cuts) == 1 else cuts
    parts = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)) // (len(cuts) - 1))
    rows = rows.withColumn("__bucket", _bucket(cuts, parts))
    heads = rows.groupBy("__bucket").agg(F.max(F.struct("doc_id", "__th")).alias("head"))
    line = Window.orderBy(F.col("__bucket"))
    above = F.coalesce(F.lead("__bucket").over(line), F.min("__bucket").over(Window.partitionBy()))
    heads = materialize(heads.select(F.col("head.doc_id").alias("__hid"), F.col("head.__th").alias("__hth"), above.alias("__to")), "order-heads")
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("__hid")) & (F.col("__th") == F.col("__hth")), "left")  # at most MOST_RANGES and 65,536 rows
    places = F.when(F.col("__to").isNull(), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.col("__to").alias("b"), F.lit(1).alias("g"))))
    kept = [c for c in ("fingerprint",) if c in rows.columns]
    dealt = rows.withColumn("__p", F.explode(places)).select("doc_id", "text", "__th", F.col("__p.b").alias("__b"), F.col("__p.g").alias("__g"), *kept)
    dealt = dealt.repartition(tasks, "__b")  # the number follows the data, so a task's share does not
    order = Window.partitionBy("__b").orderBy(F.col("__g"), F.col("doc_id").desc_nulls_last(), F.col("__th").desc())
    extra = [F.lead("fingerprint").over(order).alias("next_fingerprint")] if "fingerprint" in dealt.columns else []
    return dealt.select("*", F.lead("text").over(order).alias("next_text"), *extra).filter("__g = 0").drop("__b", "__g", "__th")


def fingerprint_likeness(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    apart = compared(docs, text)
    rows = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text")), "text", "fingerprint", apart)
    rows = next_texts(rows)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", apart)
    same = lambda fingerprint, other: F.when((F.col("fingerprint") == F.col(fingerprint)) & (canonical(F.col("text")) == canonical(F.col(other))), 1.0).otherwise(0.0)
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", same("edited_fingerprint", "edited").alias("near_edited"), same("next_fingerprint", "next_text").alias("near_next"))

