"""Cutting lineage by written tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the repository is on a shared path; elsewhere pass it with ``--py-files``."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names. Only a local master may do without that setting; it gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worked_out(rows: DataFrame, **made: Column) -> DataFrame:
    """Add columns that are worked out once for each row, before anything that follows: filters on them stay above, so neither they nor what they are made of is written out anew for every mention."""
    cells = F.struct(*[c.alias(n) for n, c in made.items()])
    return rows.select("*", F.explode(F.array(cells)).alias("__made")).select(*rows.columns, *[F.col("__made")[n].alias(n) for n in made])


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the schemas: neither is collected on the driver, as Spark would do by the size of their files, in which URLs and pointers take a small part of their length."""
    return left.join(right.hint("merge"), on, how)


#: Bytes of files that Spark reads in one task, and tasks for each core where work is dealt out.
SPLIT, TASKS = 128 << 20, 3


def spread(rows: DataFrame) -> DataFrame:
    """Rows that each mean much work, dealt over all cores where their files are too small to be read in as many tasks; others are left where they are read."""
    if rows.isStreaming:
        return rows
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if size < tasks * SPLIT else rows


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 0 in an order, without sorting them in one task: rows are dealt out by ranges of the order and written, ranges are
    counted, and a row's number is its rank in its range plus the counts of the ranges before. Only the counts, one for each range, meet in a task."""
    dealt = stored(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__rank", rank).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__rank") - 1).drop("__range", "__rank", "__before")
