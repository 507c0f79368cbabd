"""Structured Streaming: statistics, windows, sessions, alerts, replay; each also runs on a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files with a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def feedback_stats(log: DataFrame, by: str, positive: str) -> DataFrame:
    """Rows and share of positive ones by group (AGG-16, STM-03)."""
    return log.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.expr(positive).cast("double")), 4).alias("share"))


def rates(log: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows (STM-07, AGG-24)."""
    log = log.withWatermark("ts", late) if late else log
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return log.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(log: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    log = log.withWatermark("ts", late) if late else log
    return log.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(log: DataFrame, key: str, late: str) -> DataFrame:
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def alerts(values: DataFrame, label: str, least: float) -> DataFrame:
    """Changes of a label's state with the last value as state (STF-10, STM-05): firing under the bound, then ok."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "ok"
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows.itertuples():
            new = "firing" if r.value < least else "ok"
            if new != now:
                out.append((key[0], r.event_id, new))
            now = new
        state.update((now,))
        yield pd.DataFrame(out, columns=["label", "event_id", "state"])

    return values.select(F.col(label).alias("label"), "ts", "event_id", "value").groupBy("label").applyInPandasWithState(step, "label string, event_id long, state string", "state string", "append", "NoTimeout")


def replayed(deltas: DataFrame, request: str, seq: str, delta: str) -> DataFrame:
    """The text that a stream's deltas make, in their order (STM-01)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(delta).alias("d"))))
    return deltas.groupBy(request).agg(F.array_join(F.transform(parts, lambda x: x.d), "").alias("text"), F.count("*").alias("deltas"))


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and return what it made."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
