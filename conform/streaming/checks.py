"""The same checks over streams: validation keeps no state; windows of violations wait for late events up to a watermark."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from conform.operators.validate import validate_table


def stream_violations(events: DataFrame, schema: Any, keep: list[str], columns: list[str]) -> DataFrame:
    """Violations of a streaming table's rows; the plan is that of a batch."""
    return validate_table(events, schema, keep, columns)


def validate_stream(docs: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True, results: str | None = None, key: str = "cache_key") -> StreamingQuery:
    """Write the violations of a stream of documents under ``path``, whatever depth they lie at: every batch is checked as a table, in as many rounds as it needs.

    ``check`` is any batch check, as :func:`conform.operators.validate.validate_one` with its schema. A batch writes a folder of its own, so a batch that is repeated
    after a failure replaces what it wrote. With ``results``, a folder of results by ``cache_key`` (see :mod:`conform.operators.incremental`), documents
    whose key was checked in an earlier batch are not checked again, and ``check`` gives ``cache_key, errors``.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = check(batch) if results is None else _reused(batch, check, results, number, key)
        found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _reused(batch: DataFrame, check: Callable[[DataFrame], DataFrame], results: str, number: int, key: str) -> DataFrame:
    """Check what no earlier batch has checked, add it to the results, and give the results of all rows."""
    spark = batch.sparkSession
    fresh = f"{results.rstrip('/')}/run=b{number}"
    schema = check(batch.limit(0)).schema
    known = spark.read.schema(schema).option("basePath", results).parquet(f"{results.rstrip('/')}/run=*") if number else spark.createDataFrame([], schema)
    known = known.filter(~F.input_file_name().contains(f"/run=b{number}/")) if number else known
    todo = batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")
    check(todo).select(*schema.names).write.mode("overwrite").parquet(fresh)
    done = known.select(*schema.names).unionByName(spark.read.schema(schema).parquet(fresh))
    return batch.join(done, key, "left")


def windowed_violations(violations: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Violations by tumbling window, path and kind; a window is complete when the watermark has passed it."""
    rows = violations.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "instance_path", "kind").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "instance_path", "kind", "n")


def observed(docs: DataFrame, name: str = "checked") -> DataFrame:
    """The same rows; their number is a metric of the query's progress."""
    return docs.observe(name, F.count(F.lit(1)).alias("rows"))


class Progress(StreamingQueryListener):
    """Calls back with the rows of each batch."""

    def __init__(self, on_rows: Callable[[int], None]) -> None:
        self.on_rows = on_rows

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        return None

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        self.on_rows(int(event.progress.numInputRows))

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        return None

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        return None
