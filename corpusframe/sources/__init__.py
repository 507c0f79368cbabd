"""Sources and sinks: tables, JSON, reports, append logs, versioned indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_array(spark: SparkSession, path: str, key: str, schema=None) -> DataFrame:
    """A JSON array of records; of rows that repeat a key the last of the file wins (SRC-05, SRC-08)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.json(path, multiLine=True).withColumn("_at", F.monotonically_increasing_id())
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_at")))).where("_n = 1").drop("_n", "_at")


def json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines, blank ones skipped (SRC-06)."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def questions(df: DataFrame, subset: str = "all", flag: str = "ci") -> DataFrame:
    """Questions that some record answers, all of them or the flagged (SRC-06, FLT-02)."""
    return df.where((F.coalesce(F.size("relevant_articles"), F.lit(0)) > 0) & (F.lit(subset == "all") | F.col(flag)))


def pages(df: DataFrame, first: int, last: int) -> DataFrame:
    """A range of pages (SRC-04)."""
    return df.where(F.col("page").between(first, last))


def report_status(content: DataFrame, report: DataFrame) -> DataFrame:
    """REPORT_MISSING or REPORT_STALE for content (name, text) against a report (name, sha) (SRC-07)."""
    both = content.join(report, "name", "left")
    code = F.when(F.col("sha").isNull(), "REPORT_MISSING").when(F.col("sha") != F.sha2("text", 256), "REPORT_STALE")
    return both.select("name", code.alias("code"))


def report_warnings(content: DataFrame, report: DataFrame, issues: DataFrame, produced: DataFrame) -> DataFrame:
    """(name, code): a missing or stale report, or else the warnings of a valid one, ``issues`` (name, level, code),
    less the codes that this run has ``produced`` (code) itself (SRC-07)."""
    status = report_status(content, report)
    valid = status.where("code IS NULL").select("name")
    old = issues.where("level = 'warning'").join(valid, "name", "left_semi").join(produced.select("code").distinct(), "code", "left_anti")
    return status.where("code IS NOT NULL").unionByName(old.select("name", "code"))


def first_readable(spark: SparkSession, paths: list[str], key: str, schema=None) -> DataFrame:
    """The records of the first file that is there, the corpus or else a sample, with a ``topic`` by default (SRC-08)."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            rows = json_array(spark, path, key, schema)
        except AnalysisException:
            continue
        topic = F.coalesce(F.col("topic"), F.lit("General")) if "topic" in rows.columns else F.lit("General")
        return rows.withColumn("topic", topic)
    raise FileNotFoundError(", ".join(paths))


def last_rows(log: DataFrame, seq: str, n: int = 200) -> DataFrame:
    """The end of a log, newest first (SRC-15)."""
    return log.orderBy(F.desc(seq)).limit(n)


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows of a stored index, None when it cannot be read (SRC-10, API-03)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).count()
    except AnalysisException:
        return None


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, nulls left out, replaced as a whole (SNK-01, JSN-01)."""
    df.write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Events, runs, gauges or alerts with the time of writing (SNK-06, SNK-10, SNK-11, SNK-14)."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Training rows by split as JSON lines (SNK-05)."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def upsert_version(spark: SparkSession, path: str, new: DataFrame, key: str, batch_id: int) -> None:
    """A micro-batch into a versioned table: version ``batch_id`` holds the merge; writing it again changes
    nothing, and readers of an older version are not disturbed (STM-06, SNK-03)."""
    from ..operators.incremental import merged

    old = current_version(spark, path, batch_id)
    (merged(old, new, key) if old is not None else new).write.mode("overwrite").parquet(f"{path}/v={batch_id:020d}")


def current_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest finished version, or the newest before a batch."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop))
    done = [n for n in names if n.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) and (before is None or int(n[2:]) < before)]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None
