"""Statistics of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timing_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``mean, least, most, median, runs`` of each key; the median of an even number is the upper one.

    Equal values are counted before they are ranked, so a group's rows are never gathered: distinct values are.
    """
    from pyspark.sql import Window

    per = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    up = F.sum("__n").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    ranked = per.withColumns({"__up": up, "__total": total})
    place = F.floor(F.col("__total") / 2) + 1
    middle = ranked.filter((F.col("__up") >= place) & (F.col("__up") - F.col("__n") < place)).select(*keys, F.col(value).alias("median"))
    basics = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("runs"))
    return basics.join(middle, list(keys))


def schema_test_pairs(schemas: DataFrame, files: DataFrame) -> DataFrame:
    """Schemas (``stem, uri``) and test files (``path``) whose folder has the schema's name."""
    return files.withColumn("stem", F.get(F.reverse(F.split("path", "/")), 1)).join(schemas, "stem")
