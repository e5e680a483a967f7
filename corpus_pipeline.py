"""A corpus pipeline of four of the operators in ``conform.llm``: each stage reads what the one before has written.

Defined cases: documents with a null or empty text are clean (they have no hits), differ from all others but those equal in id and text, have no words to mix,
so they follow the key of their id, and give no tokens; documents without an id are kept apart by their texts, and share one key in the mix; repeated rows are one
document after the second stage; a source's cut takes rows of one key together; texts of any length are read whole; an empty table gives an
empty one; other columns, whatever their names, are handed on until the last stage, which returns counts and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conform.llm.bpe_codec import round_trip
from conform.llm.common import materialize, table
from conform.llm.ngram_join import deduplicated
from conform.llm.queries import tokenizer_path
from conform.llm.source_mixing import mixed_documents
from conform.llm.toxicity import clean_documents, fit_scorer, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    return clean_documents(docs, fit_scorer(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of identifiers and decoded texts."""
    return round_trip(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("source_mixing", mix), ("bpe_round_trip", encode)]
#: SQL cannot express the learned scores of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
