"""Diagnostics: one table of findings of all kinds, their summary, and the reports made of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.functions.text import escape_command, forward_slashes, label, line_col, pointer_span
from conform.plans.stored import numbered

#: Titles of the codes, fixed by the report's format.
TITLES = {"parse": "parse error", "validation": "validation error", "schema_mismatch": "schema mismatch", "io": "io error", "schema_fetch": "schema fetch error", "schema_compile": "schema compile error", "format": "format error"}
COLUMNS = ("path", "code", "message", "instance_path", "schema_path", "kind", "line", "col", "offset", "length")
BATCH = 50


def with_places(violations: DataFrame, contents: DataFrame) -> DataFrame:
    """Join the documents' text back to violations for spans, lines and columns; ``contents`` has ``path, content``."""
    rows = violations.join(contents.select("path", "content"), "path")
    rows = rows.withColumn("__span", pointer_span(F.col("content"), F.col("instance_path")))
    rows = rows.withColumn("__at", line_col(F.col("content"), F.col("__span.offset")))
    return rows.withColumns({"offset": F.col("__span.offset"), "length": F.col("__span.length"), "line": F.col("__at.line"), "col": F.col("__at.col")}).drop("__span", "__at", "content")


def diagnostics(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The union of findings of different kinds, missing columns null, ``code`` as given or as the part has it."""
    out = None
    kinds = {"line": "int", "col": "int", "offset": "int", "length": "int"}
    for code, df in parts:
        have = set(df.columns)
        cells = [F.lit(code).alias("code") if c == "code" and "code" not in have else F.col(c).cast(kinds.get(c, "string")).alias(c) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]
        part = df.select(*cells)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no findings")
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """By path and byte offset; kinds without a place stand at 0. For output only."""
    return rows.orderBy("path", F.coalesce("offset", F.lit(0)), "code", "message")


def summary(checked: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: ``files_checked, errors_found, had_errors``."""
    n = checked.agg(F.count(F.lit(1)).alias("files_checked"))
    return n.crossJoin(errors.agg(F.count(F.lit(1)).alias("errors_found"), (F.count(F.lit(1)) > 0).alias("had_errors")))  # one row each


def counts_by(errors: DataFrame, *columns: str, subtotals: bool = False) -> DataFrame:
    return (errors.rollup(*columns) if subtotals else errors.groupBy(*columns)).agg(F.count(F.lit(1)).alias("n"))


def _title() -> Column:
    title = F.when((F.col("code") == "validation") & (F.col("instance_path") != ""), F.col("instance_path"))
    for code, said in TITLES.items():
        title = title.when(F.col("code") == code, said)
    return title


def text_report(rows: DataFrame) -> DataFrame:
    """``error: path: message (at pointer)`` lines."""
    place = F.when((F.col("code") == "validation") & (F.col("instance_path") != ""), F.concat(F.lit(" (at "), "instance_path", F.lit(")"))).otherwise("")
    return rows.select(F.concat(F.lit("error: "), "path", F.lit(": "), "message", place).alias("value"))


def command_report(rows: DataFrame) -> DataFrame:
    """CI command lines with file, line, column and title."""
    line, col = F.coalesce("line", F.lit(1)).cast("string"), F.coalesce("col", F.lit(1)).cast("string")
    return rows.select(F.concat(F.lit("::error file="), forward_slashes(F.col("path")), F.lit(",line="), line, F.lit(",col="), col, F.lit(",title="), _title(), F.lit("::"), escape_command(F.col("message"))).alias("value"))


def annotations(rows: DataFrame) -> DataFrame:
    """Annotation rows ``batch, path, start_line, end_line, annotation_level, message, title`` in batches of 50, by path and offset."""
    ranked = numbered(rows.withColumns({"__off": F.coalesce("offset", F.lit(0)), "__at": F.coalesce("instance_path", F.lit(""))}), ["path", "__off", "code", "message", "__at"], "__i")
    line = F.coalesce("line", F.lit(1))
    return ranked.select(F.floor(F.col("__i") / BATCH).alias("batch"), forward_slashes(F.col("path")).alias("path"), line.alias("start_line"), line.alias("end_line"), F.lit("failure").alias("annotation_level"), "message", _title().alias("title"))


def markdown_summary(notes: DataFrame, files_checked: int, ms: int) -> DataFrame:
    """A Markdown table for each batch of annotations."""
    head = f"Checked **{files_checked}** files in **{ms}ms**.\n\n| File | Line | Error |\n|------|------|-------|\n"
    row = F.struct("path", "start_line", F.concat(F.lit("| `"), "path", F.lit("` | "), F.col("start_line").cast("string"), F.lit(" | "), "message", F.lit(" |\n")).alias("text"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), "")
    return notes.groupBy("batch").agg(F.concat(F.lit(head), lines).alias("summary"))


def with_labels(violations: DataFrame) -> DataFrame:
    return violations.withColumn("label", label(F.col("instance_path"), F.col("schema_path")))


def write_text(rows: DataFrame, path: str) -> None:
    """A report's lines as text files."""
    rows.select("value").write.mode("overwrite").text(path)
