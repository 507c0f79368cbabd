"""Alerts in time (STF-10, STM-05): a label is looked at on every tick, whether or not it has spoken since.

On a tick a label's value is the last one up to it. It is ``silent`` once nothing has come for ``quiet`` seconds, ``firing`` once
its value has been below the bound on all ticks of ``hold`` seconds, else ``ok``. Both forms give the changes of that
state: ``timeline`` a batch query, ``watched`` a stream whose ticks are timers, so that it fires and resolves without new
events of the label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "label string, tick long, state string"


def _rows(values: DataFrame, label: str, ts: str, value: str, every: int) -> DataFrame:
    """(label, tick, us, value): microseconds of an event and the first tick, in seconds, that sees it."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return values.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(F.col(ts).alias("ts"), F.col(label).cast("string").alias("label"), (F.ceil(us / (every * 1_000_000)) * every).cast("long").alias("tick"), us.alias("us"), F.col(value).cast("double").alias("value"))


def timeline(values: DataFrame, label: str, ts: str, value: str, least: float, every: int = 30, hold: int = 0, quiet: int = 300) -> DataFrame:
    """(label, tick, state): every change of each label's state up to its last event and the silence behind it.

    Ticks without an event are made only where the state can change: until a value has held long enough and at the
    tick that finds silence; so rows grow with the events. Of values with equal times the larger one is the last. Null
    times and values are no events; a null label is one label.
    """
    if quiet < every:
        raise ValueError("quiet >= every")
    last = _rows(values, label, ts, value, every).groupBy("label", "tick").agg(F.max(F.struct("us", "value")).alias("v")).select("label", "tick", "v.us", "v.value")
    by = W.partitionBy("label").orderBy("tick")
    # a silent label starts anew: ticks below the bound count from the first one behind the silence
    silent_at = (F.ceil((F.col("us") + quiet * 1_000_000) / (every * 1_000_000)) * every).cast("long")
    rows = last.withColumn("silent_at", silent_at).withColumn("next", F.lead("tick").over(by))
    rows = rows.withColumn("below", F.col("value") < least).withColumn("heard", F.coalesce(F.lag("silent_at").over(by) >= F.col("tick"), F.lit(False)))
    starts = F.col("below") & ~(F.col("heard") & F.coalesce(F.lag("below").over(by), F.lit(False)))
    rows = rows.withColumn("since", F.when(F.col("below"), F.max(F.when(starts, F.col("tick"))).over(by)))
    held = F.col("since") + F.lit(-(-hold // every) * every)
    end = F.least(F.coalesce("next", F.lit((1 << 62))), F.col("silent_at"))
    at = lambda tick, state: F.struct(tick.cast("long").alias("tick"), F.lit(state).alias("state"))
    fires = F.when(F.col("below") & (F.greatest(held, F.col("tick")) < end), at(F.greatest(held, F.col("tick")), "firing"))
    well = F.when(~F.col("below") | (held > F.col("tick")), at(F.col("tick"), "ok"))
    quiet_now = F.when(F.col("next").isNull() | (F.col("silent_at") < F.col("next")), at(F.col("silent_at"), "silent"))
    points = rows.select("label", F.explode(F.array_compact(F.array(well, fires, quiet_now))).alias("p")).select("label", "p.tick", "p.state")
    before = F.coalesce(F.lag("state").over(by), F.lit("ok"))
    return points.withColumn("_b", before).where("state <> _b").drop("_b")


class Watch(StatefulProcessor):
    """A label's state over the ticks: its last value, since when it is below the bound, the tick that a timer waits for,
    the last one looked at, and the values of ticks to come."""

    def __init__(self, least: float, every: int, hold: int, quiet: int, in_events: bool):
        self.least, self.every, self.hold, self.quiet, self.in_events = least, every, hold, quiet, in_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, us long, value double, since long, waits long, done long")
        self.coming = handle.getMapState("coming", "tick long", "us long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, us, value, since, waits, done = self.now.get() if self.now.exists() else ("ok", None, None, None, None, None)
        first = None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                tick = int(r.tick)
                if done is not None and tick <= done:
                    if self.in_events:
                        continue  # late: its tick has been looked at
                    tick = done + self.every
                held = self.coming.getValue((tick,)) if self.coming.containsKey((tick,)) else None
                if held is None or (r.us, r.value) > tuple(held):
                    self.coming.updateValue((tick,), (int(r.us), float(r.value)))
                first = tick if first is None else min(first, tick)
        if first is not None and (waits is None or first < waits):
            if waits is not None:
                self.handle.deleteTimer(waits * 1000)
            self.handle.registerTimer(first * 1000)
            self.now.update((state, us, value, since, first, done))
        yield _changes([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, us, value, since, tick, done = self.now.get()
        until = (timerValues.getCurrentWatermarkInMs() if self.in_events else timerValues.getCurrentProcessingTimeInMs()) // 1000
        out = []
        while tick is not None and tick <= until:
            if self.coming.containsKey((tick,)):
                us, value = self.coming.getValue((tick,))
                self.coming.removeKey((tick,))
            if tick * 1_000_000 - us >= self.quiet * 1_000_000:
                new, since = "silent", None
            elif value < self.least:
                since = tick if since is None else since
                new = "firing" if tick - since >= self.hold else "ok"
            else:
                new, since = "ok", None
            if new != state:
                out.append((key[0], tick, new))
                state = new
            done = tick
            tick = tick + self.every if state != "silent" else min((int(k[0]) for k in self.coming.keys()), default=None)
        self.now.update((state, us, value, since, tick, done))
        if tick is not None:
            self.handle.registerTimer(tick * 1000)
        yield _changes(out)


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["label", "tick", "state"]).astype({"label": "str", "tick": "int64", "state": "str"})


def watched(values: DataFrame, label: str, ts: str, value: str, least: float, every: int = 30, hold: int = 0, quiet: int = 300, late: str = "1 minute", in_events: bool = True) -> DataFrame:
    """The changes of ``timeline`` from a stream, by ``transformWithState``: with ``in_events`` a tick is looked at once the
    watermark, ``late`` behind the newest event of all labels, has passed it; else once the clock has. A label that is
    silent has no timer, so it costs nothing until it speaks again. Needs the RocksDB state store."""
    source = values.withWatermark(ts, late) if in_events else values
    rows = _rows(source, label, ts, value, every)
    return rows.groupBy("label").transformWithStateInPandas(Watch(least, every, hold, quiet, in_events), OUT, "append", "EventTime" if in_events else "ProcessingTime")
