"""Incremental maintenance, deterministic samples, splits and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def classified(index: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """New rows as added, changed or unchanged (JOI-05, O7)."""
    old = index.select(key, F.col(content).alias("_old"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "added").when(F.col(content).eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return new.join(old, key, "left").withColumn("status", status).drop("_old", "_known")


def merged(old: DataFrame, new: DataFrame, key: str, last: str | None = None) -> DataFrame:
    """New rows win by key (SNK-03, SNK-04, JOI-06). Of new rows that repeat a key the last one counts: by the column
    ``last``, which then goes, else in the order in which they are read. Null is a key like any other."""
    order = F.col(last) if last else F.monotonically_increasing_id()
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_at")))
    one = new.withColumn("_at", order).withColumn("_n", n).where("_n = 1").drop("_n", "_at", *([last] if last else []))
    known = one.select(F.col(key).alias("_key"))
    return one.unionByName(old.join(known, old[key].eqNullSafe(known["_key"]), "left_anti"))


def merged_corpus(old: DataFrame, new: DataFrame, key: str, last: str | None = None) -> DataFrame:
    """A corpus with new records in it, in the order of the key (SNK-04)."""
    return merged(old, new, key, last).orderBy(key)


def ensured(index_rows: int | None, corpus_rows: int, fetched: int | None) -> str:
    """What a missing or short index needs (VEC-07): ``ready`` as it is, ``pull`` a stored one that is whole, else ``build``."""
    if index_rows is not None and index_rows >= corpus_rows > 0:
        return "ready"
    return "pull" if fetched is not None and fetched >= corpus_rows > 0 else "build"


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same ones in every run (RND-01)."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def sample_sorted(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement, in the order of their keys (RND-02)."""
    return sample(df, key, n, seed).orderBy(key)


def split_summary(rows: DataFrame, positive: str) -> DataFrame:
    """Rows, and different positives, of each split: what is written beside the training files (SNK-05)."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(positive).alias("positives"))


def split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A fixed share of the keys goes to ``val`` (SNK-05): by the first eight hex digits of their hash."""
    bucket = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(bucket < share, "val").otherwise("train"))


def held_out(pool: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """The pool without anything that is evaluated (JOI-12)."""
    return pool.join(evaluation.select(key), key, "left_anti")


def traffic(key: str, weight: int) -> Column:
    """A fixed share of keys, in percent, goes to the canary (STF-11)."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % 100
    return F.when(bucket < weight, "canary").otherwise("stable")


def failed_over(calls: DataFrame, side: str, ts: str, ok: str, fails: int = 2, seconds: int = 10) -> DataFrame:
    """Calls with ``down``: their side has failed so many times in the seconds before them (STF-11)."""
    recent = W.partitionBy(side).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, -1)
    return calls.withColumn("down", F.coalesce(F.sum((~F.col(ok)).cast("int")).over(recent), F.lit(0)) >= fails)


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def status(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """Counts of both and whether the index is stale or usable (MIS-13, MIS-14, VEC-07, API-01)."""
    a, b = index.agg(F.count("*").alias("indexed")), corpus.agg(F.count("*").alias("records"))
    return a.join(b, F.lit(True)).withColumn("stale", F.col("indexed") != F.col("records")).withColumn("usable", (F.col("indexed") >= F.col("records")) & (F.col("indexed") > 0))


def go_ahead(warnings: str, stop: str, yes: str, interactive: str) -> Column:
    """The warning gate (STF-07)."""
    return F.when(F.col(warnings) == 0, "go").when(F.col(stop), "no").when(F.col(yes), "go").when(~F.col(interactive), "no").otherwise("ask")


def replicas(free, margin, per, most: int, batches) -> Column:
    """max(1, min(fit, most, batches)) (STF-06)."""
    return F.greatest(F.lit(1), F.least(F.floor((free - margin) / per).cast("int"), F.lit(most), batches))
