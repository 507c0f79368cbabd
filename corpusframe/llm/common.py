"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import cut, remove, shared_folder, table_path

__all__ = ["cut", "remove", "shared_folder", "table_path"]

#: ASCII white space; words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: What operators keep in a Python worker between tasks; workers are shared by all stages of an executor.
_kept: list[dict] = []


def keep(cache: dict) -> dict:
    """Name a cache that other operators may empty when they start on the same worker."""
    _kept.append(cache)
    return cache


def forget() -> None:
    """Empty what other operators keep in this worker, so that memories do not add up over stages."""
    for cache in _kept:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Up to so many hashes of rows that come again are broadcast; beyond that they are joined by shuffle.
BROADCAST_HASHES = 500_000


def document_hash(key: str, text: str) -> Column:
    """The MD5 of a row's key and text."""
    return F.md5(F.concat_ws("-", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)))


def _hashed(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(lang).alias("lang"), document_hash(key, text).alias("hash"), F.col(text).alias("text"))


def labelled(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, hash, text): every labelled document, with the MD5 of key and text; rows that repeat both are one document.
    Null labels and texts are none. Hashes alone are shuffled, and the texts of rows that come again.
    """
    rows, on = _hashed(docs, key, text, lang), ["lang", "hash"]
    again = cut(rows.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").select(*on))
    n = again.count()
    if n == 0:
        return rows
    again = F.broadcast(again) if n <= BROADCAST_HASHES else again
    return rows.join(again, on, "left_anti").unionByName(rows.join(again, on, "left_semi").groupBy(*on).agg(F.first("text").alias("text")))


def sampled(docs: DataFrame, key: str, text: str, lang: str, size: int) -> DataFrame:
    """(lang, hash, text): at most ``size`` labelled documents of each label, those with the smallest MD5 of key
    and text, so rows that repeat both are one document. Null labels and texts are none.

    The number of different hashes, estimated within a few percent, gives a bound that at least ``size`` of them
    stay under; only rows under it are shuffled, combined by hash before. One number a label comes to the driver.
    """
    hashed = _hashed(docs, key, text, lang)
    within = F.lit(False)
    for r in hashed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect():
        bound = f"{min((1 << 48) - 1, int((1 << 48) * (2 * size + 50) / max(1, r.n))):012x}"
        within = within | ((F.col("lang") == r.lang) & (F.substring("hash", 1, 12) <= bound))
    few = hashed.where(within).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    return few.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("hash"))).where(F.col("_n") <= size).drop("_n")


def fresh(name: str, df: DataFrame) -> str:
    """A column name like this one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wide(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by a key, so that one input split of long texts is no task of its own."""
    return df.repartition(key)
