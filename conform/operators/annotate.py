"""Schema references written into documents, and taken out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROPERTY = r'"\$schema"\s*:\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MODELINE = r"(?m)^[^\S\n]*#\s*yaml-language-server:\s*\$schema=[^\n]*\n?"
_COMMENT = r"(?m)^[^\S\n]*#\s*(?::schema|\$schema:)[^\n]*\n?"


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def annotated(format_: Column, content: Column, uri: Column) -> Column:
    """The text with a reference to a schema; null for a format that has no place for one."""
    brace = F.position(F.lit("{"), content)
    head, tail = F.substring(content, F.lit(1), brace), F.substring(content, brace + 1, F.length(content))
    pair = F.concat(F.lit('"$schema": "'), _quoted(uri), F.lit('"'))
    indent = F.regexp_extract(tail, r"^(\s*\n[^\S\n]*)", 1)
    comma = F.when(tail.rlike(r"^\s*\}"), F.lit("")).otherwise(F.lit(","))
    json = F.when(brace > 0, F.concat(head, F.when(indent == "", F.lit("")).otherwise(indent), pair, comma, F.when((indent == "") & (comma == ",") & ~tail.rlike(r"^\s"), F.lit(" ")).otherwise(F.lit("")), tail))
    return F.when(format_.isin("jsonc", "json5"), json).when(format_ == "yaml", F.concat(F.lit("# yaml-language-server: $schema="), uri, F.lit("\n"), content)).when(format_ == "toml", F.concat(F.lit("# :schema "), uri, F.lit("\n"), content))


def stripped(format_: Column, content: Column) -> Column:
    """The text without its reference; all else as it was."""
    json = F.regexp_replace(F.regexp_replace(content, rf"(?s)^([^{{]*\{{)(\s*){_PROPERTY}\s*,(\s*?)(?=\s*\S)", "$1"), rf"(?s)(?:,\s*)?{_PROPERTY}", "")
    return F.when(format_.isin("jsonc", "json5"), json).when(format_ == "yaml", F.regexp_replace(content, _MODELINE, "")).when(format_ == "toml", F.regexp_replace(content, _COMMENT, "")).otherwise(content)


def annotate(docs: DataFrame, update: bool = False) -> DataFrame:
    """Add ``new_content, outcome`` (annotated, updated, skipped or error) to ``format, content, inline_uri, schema_uri``.

    A document that names its schema is skipped, or written anew with ``update``.
    """
    has, wants = F.col("inline_uri").isNotNull(), F.col("schema_uri").isNotNull()
    fresh = annotated(F.col("format"), F.col("content"), F.col("schema_uri"))
    again = annotated(F.col("format"), stripped(F.col("format"), F.col("content")), F.col("schema_uri"))
    renew = F.lit(update) & has & wants & (F.col("inline_uri") != F.col("schema_uri"))
    outcome = F.when(F.col("content").isNull(), "error").when(has & ~renew, "skipped").when(~wants, "skipped").when(renew, F.when(again.isNull(), "skipped").otherwise("updated")).otherwise(F.when(fresh.isNull(), "skipped").otherwise("annotated"))
    rows = docs.withColumn("outcome", outcome)
    return rows.withColumn("new_content", F.when(F.col("outcome") == "annotated", fresh).when(F.col("outcome") == "updated", again).otherwise(F.col("content")))


def outcome_counts(annotated_docs: DataFrame) -> DataFrame:
    return annotated_docs.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
