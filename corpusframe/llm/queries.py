"""The queries of the training-data operators: each applies one with its production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bpe, chunks, fingerprint, language, licences, minhash, mixing, privacy, quality, suffixes, tries, vectors
from .common import documents
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "privacy_key", "tokenizer_path"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def privacy_key(spark: SparkSession) -> str:
    """The key of a deployment; the test tables, which hold no real person's data, are read under a public one."""
    return spark.conf.get(privacy.KEY_SETTING, None) or "public key of the test tables"


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir))


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(documents(spark, sf_dir), tokenizer_path()))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymized(documents(spark, sf_dir).select("doc_id", "text"), privacy_key(spark), count="n_private")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(documents(spark, sf_dir)).drop("spans")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digests(fingerprint.compared(documents(spark, sf_dir)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    dictionaries = language.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    return language.identified(docs.select("doc_id", "text"), dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", language.told("lang_pred", "score").alias("accepted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judged(docs, quality.References(docs, sample=quality.SAMPLE))  # the limit that its SQL names


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: sizes and targets."""
    return op1_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the decoded texts are the texts."""
    return op3_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: which words lie in passages of 50 words that other documents hold too."""
    return op5_suffix_dedup(spark, sf_dir).select("doc_id", F.col("first_word").cast("long").alias("first_word"), F.col("n_words").cast("long").alias("n_words"))


def winnow_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: lengths and edited texts."""
    return op8_winnow(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: the fold of a document, and whether it has a letter at all."""
    return op9_language(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


def quality_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 with references fitted on every labelled document; op10 itself keeps to the sample that its SQL names."""
    return quality.judged_by_all(documents(spark, sf_dir))


_OPERATORS = (op1_mix, op2_chunk_dedup, op3_bpe, op4_pii, op5_suffix_dedup, op6_licences, op7_minhash, op8_winnow, op9_language, op10_quality, op11_trie, op12_vectors, op13_archives)
_PARTS = (mix_targets, bpe_round_trip, suffix_passages, winnow_edits, language_folds)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*_OPERATORS, *_PARTS, quality_fitted)}
