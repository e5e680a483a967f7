"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_gru_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.gru_lm import held_out, score_documents

    scored = score_documents(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.fingerprints import fingerprint_likeness

    return fingerprint_likeness(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from conform.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.PATTERN)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.bpe_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.warc_zip import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.media_columns import media_columns

    return media_columns(table(spark, sf_dir, "documents")).drop("shard", "digest")  # the digest is payload_sha256; a shard's name is another in each run


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.rendezvous import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.source_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.llm.merkle import dataset_manifest

    return dataset_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_gru_lm_score, op2_ngram_jaccard_join, op3_document_fingerprints, op4_toxicity, op5_token_counts, op6_bpe_round_trip, op7_warc_zip, op8_media_columns, op9_rendezvous_sharding, op10_source_mixing, op11_suffix_dedup, op12_embedding_whitening, op13_merkle_manifest]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from conform.llm.merkle import sql as hashing
    from conform.llm.ngram_join import SQL as joining
    from conform.llm.rendezvous import sql as sharding
    from conform.llm.source_mixing import SQL as mixing
    from conform.llm.warc_zip import SQL as archiving

    return {"op2_ngram_jaccard_join": joining, "op7_warc_zip": archiving, "op9_rendezvous_sharding": sharding(), "op10_source_mixing": mixing, "op13_merkle_manifest": hashing()}
