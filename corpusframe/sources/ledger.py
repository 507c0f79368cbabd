"""Sinks of streams that write each micro-batch once, however often it is replayed (SNK-06, SNK-10, SNK-11, SNK-14,
STM-03).

A batch is written to a folder of its own, which a replay overwrites, and counts from the moment that its number is
in the ledger: an empty file that can be made once. A batch that was stopped between the two is written again under the
same number; one that is in the ledger is skipped. Readers see the folders of the ledger's batches alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _mark(spark: SparkSession, path: str, batch_id: int) -> None:
    fs, where = _path(spark, f"{path}/ledger/{batch_id:020d}")
    fs.create(where, False).close()


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that count, in their order."""
    fs, where = _path(spark, f"{path}/ledger")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []


def write_once(df: DataFrame, path: str, batch_id: int) -> bool:
    """Write a micro-batch unless the ledger has it; whether it was written. Rows get the time of writing."""
    spark = df.sparkSession
    fs, where = _path(spark, f"{path}/ledger/{batch_id:020d}")
    if fs.exists(where):
        return False
    df.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batches/id={batch_id:020d}")
    _mark(spark, path, batch_id)
    return True


def sink(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` takes: rows as ``shape`` makes them (runs, gauges, alert lines) are written once."""
    return lambda df, batch_id: write_once(shape(df), path, batch_id) and None


def rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows of the batches that count, with their batch's number as ``id``."""
    done = batches(spark, path)
    if not done:
        return spark.createDataFrame([], f"{schema}, written_at timestamp, id long" if schema else "id long")
    reader = spark.read.schema(f"{schema}, written_at timestamp, id long") if schema else spark.read
    return reader.option("basePath", f"{path}/batches").parquet(*(f"{path}/batches/id={b:020d}" for b in done)).withColumn("id", F.col("id").cast("long"))


def gauges(written: DataFrame, group: str) -> DataFrame:
    """Of each group the rows of the last batch that pushed it, as a push replaces its group (SNK-11). The number of the
    last batch of each group is worked out first, before the shuffle as far as it goes."""
    last = written.groupBy(F.col(group).alias("_g")).agg(F.max("id").alias("_last"))
    return written.join(last, written[group].eqNullSafe(last["_g"]) & (F.col("id") == F.col("_last")), "left_semi")


def alert_lines(transitions: DataFrame) -> DataFrame:
    """(line): an alert's change as one JSON line (SNK-14)."""
    return transitions.select(F.to_json(F.struct(*transitions.columns)).alias("line"))


def latest_runs(written: DataFrame, name: str) -> DataFrame:
    """The last batch's row of each run name (SNK-10)."""
    return written.withColumn("_n", F.row_number().over(W.partitionBy(name).orderBy(F.desc("id")))).where("_n = 1").drop("_n")
