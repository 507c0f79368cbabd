"""A training-data pipeline over ``documents``: language, near duplicates, privacy, mixing, tokens.

Every stage takes (spark, docs, sf_dir); its result is written and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm import bpe, language, minhash, mixing, privacy
from corpusframe.llm.common import DOCUMENT_COLUMNS, shared_folder
from corpusframe.llm.queries import privacy_key, tokenizer_path

#: Shared shingles of five words, in percent of the union, from which two documents are near duplicates.
NEAR = 80


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told by a margin go, among them null texts and those without a letter.
    Rows that repeat stay or go together; an empty table gives an empty one."""
    docs = docs.select(DOCUMENT_COLUMNS)
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays; null, empty and blank texts and rows with a
    null id stay too. Rows that repeat an id are one document and stay or go together."""
    docs = docs.select(DOCUMENT_COLUMNS)
    kept = minhash.near_duplicates(docs, percent=NEAR).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values get pseudonyms; no row goes. Null and empty texts stay as they are."""
    return privacy.pseudonymized(docs.select(DOCUMENT_COLUMNS), privacy_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that words of a document are taken, so none for null, empty and blank texts; rows
    that repeat are documents of their own, a null source is one source."""
    return mixing.mixed_documents(docs.select(DOCUMENT_COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, a row each; the decoded text comes as its digest. A null text has no ids."""
    tokens = bpe.encode_decode(docs, tokenizer_path(), keep=["lang", "source"])
    return tokens.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", tell_language), ("near_duplicates", drop_near_duplicates), ("privacy", hide_private), ("mix", mix_sources), ("encode", encode)]

#: SQL cannot express the stages; tests/llm/test_brute_force.py checks each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the folder that
    ``spark.checkpoint.dir`` names (on one machine a temporary one where it is unset) and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
