"""Checking only what is new: results by content, schema and flags; schemas with a time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
TTL_HOURS = 12


def cache_key(content: Column, schema_hash: Column, formats: Column, version: str = VERSION) -> Column:
    """SHA-256 over version, content, schema digest and the flag's byte."""
    return F.sha2(F.concat(F.lit(version), content, schema_hash, F.when(formats, F.lit("\x01")).otherwise(F.lit("\x00"))), 256)


def split_by_cache(docs: DataFrame, results: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Documents with a stored result (and that result), and the documents without. A key that is stored twice counts once."""
    results = results.dropDuplicates([key])
    hits = docs.join(results, key)
    misses = docs.join(results.select(key), key, "left_anti")
    return hits, misses


def incremental_validate(docs: DataFrame, results: DataFrame, check: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Every document with its ``errors``, and the new rows of the result table.

    ``check`` takes one document of each new key and returns ``key, errors``; equal contents are looked at once however often they come.
    """
    hits, misses = split_by_cache(docs, results, key)
    fresh = check(misses.dropDuplicates([key])).select(key, "errors")
    done = hits.withColumn("status", F.lit("hit")).unionByName(misses.join(fresh, key).withColumn("status", F.lit("miss")))
    return done, fresh


def store_results(fresh: DataFrame, path: str, run: str, key: str = "cache_key") -> None:
    """Write a run's new results by key prefix, under the run's own name: a run that is repeated replaces what it wrote, other runs stay."""
    rows = fresh.withColumn("prefix", F.substring(key, 1, 2))
    rows.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{path.rstrip('/')}/run={run}")


def load_results(spark: SparkSession, path: str, key: str = "cache_key") -> DataFrame:
    """The stored results of all runs, one for each key: the last run's, by the order of their names."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (key, "run", "prefix")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col("run").cast("string")).alias("__best"))
    return best.select(key, *[F.col("__best")[c].alias(c) for c in others])


def status_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def refresh_schema_store(store: DataFrame, landed: DataFrame, now: Column, ttl_hours: int = TTL_HOURS, force: bool = False) -> DataFrame:
    """The store after landing: new bodies replace old ones, equal bodies only get the new time; ``changed`` and ``stale`` say which.

    Both have ``uri, body, fetched_at``; rows of ``landed`` count where the stored one is stale, missing, or with ``force``.
    """
    hashed = lambda df, tag: df.select("uri", F.col("body").alias(f"{tag}_body"), F.sha2("body", 256).alias(f"{tag}_hash"), F.col("fetched_at").alias(f"{tag}_at"))
    both = hashed(store, "old").join(hashed(landed, "new"), "uri", "full")
    stale = F.coalesce(F.col("old_at") < now - F.expr(f"INTERVAL {ttl_hours} HOURS"), F.lit(True)) | F.lit(force)
    take = F.col("new_body").isNotNull() & stale
    return both.select(
        "uri", F.sha2("uri", 256).alias("uri_hash"), F.when(take, F.col("new_body")).otherwise(F.col("old_body")).alias("body"), F.when(take, F.col("new_hash")).otherwise(F.col("old_hash")).alias("content_hash"),
        F.when(take, F.col("new_at")).otherwise(F.col("old_at")).alias("fetched_at"), (take & (F.col("old_hash").isNull() | (F.col("old_hash") != F.col("new_hash")))).alias("changed"), (stale & ~take & F.col("old_at").isNotNull()).alias("stale"),
    ).filter(F.col("body").isNotNull())
