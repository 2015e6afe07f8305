"""Keyed state on streams: a latch that fires once a run, and a queue of pending events.

Both run under ``transformWithState``, which keeps each key's state in the RocksDB
provider (``state_session``).  A key's rows of one batch are reduced chunk by
chunk, so what a task holds is bounded by the ticks and distinct events that a run
has in one batch, not by its raw rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep state by column families; the caller's keeps its settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


# ---------------------------------------------------------------- T2: the latch
class _Latch(StatefulProcessor):
    """Fires with the earliest row of the first batch that has one, then never again while it lives.

    A timer ends the latch once the watermark is ``idle_us`` past the key's last row.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = value = latest = None
        for part in rows:
            low = part["us"].min()
            at = part.loc[part["us"] == low, "value"].max()
            if first is None or low < first or (low == first and at > value):
                first, value = low, at
            high = part["us"].max()
            latest = high if latest is None else max(latest, high)
        fired = self.last.get()[0] if self.last.exists() else None
        latest = int(latest) if fired is None else max(int(latest), fired)
        self.last.update((latest,))
        self.handle.registerTimer((latest + self.idle_us) // 1000)
        if fired is None:
            yield pd.DataFrame({"run": [key[0]], "us": [int(first)], "value": [float(value)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.last.exists() and (self.last.get()[0] + self.idle_us) // 1000 <= now:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_crossings(samples: DataFrame, threshold: float, key: str = "run_key", ts: str = "ts",
                    value: str = "progress", watermark: str = "2 days", idle_days: int = 365) -> DataFrame:
    """``(key, first_ts_us, value_at)`` the first time a run reaches ``threshold``, once a run.

    Only rows at or above the threshold reach the state.  State is one number a run and goes
    once no such row has come for ``idle_days`` of event time; a run that crosses again after
    that counts as a new one.  A run's first crossing is decided by the batch that brings one.
    Rows without a time cannot be ordered and are left out, as the batch operator leaves them.
    """
    above = (samples.where((F.col(value) >= threshold) & F.col(ts).isNotNull()).withWatermark(ts, watermark)
             .select(key, ts, F.unix_micros(ts).alias("us"), F.col(value).cast("double").alias("value")))
    kind = samples.schema[key].dataType.simpleString()
    fired = above.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Latch(idle_days * 86_400_000_000),
        outputStructType=f"run {kind}, us bigint, value double", outputMode="Append", timeMode="eventTime")
    return fired.select(F.col("run").alias(key), F.col("us").alias("first_ts_us"), F.col("value").alias("value_at"))


# ---------------------------------------------------------------- J5: the queue
class _Queue(StatefulProcessor):
    """A run's pending events in order; each tick takes the oldest one off."""

    def init(self, handle) -> None:
        self.pending = handle.getListState("pending", StructType([StructField("event", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks, events, untimed = {}, Counter(), (0.0, 0.0, 0)
        for part in rows:
            is_tick = part["event"].isna()
            loose, part = part[is_tick & ~part["timed"]], part[part["timed"]]
            untimed = (untimed[0] + loose["cpu"].sum(), untimed[1] + loose["mem_bytes"].sum(), untimed[2] + len(loose))
            is_tick = is_tick[part.index]
            sums = part[is_tick].groupby("us").agg(cpu=("cpu", "sum"), mem=("mem_bytes", "sum"), n=("us", "size"))
            for us, cpu, mem, n in sums.itertuples():
                old = ticks.get(us, (0.0, 0.0, 0))
                ticks[us] = (old[0] + cpu, old[1] + mem, old[2] + n)
            events.update(zip(part.loc[~is_tick, "us"], part.loc[~is_tick, "event"]))
        queue = [e for (e,) in self.pending.get()] if self.pending.exists() else []
        coming = sorted(events.items())
        out, taken, at = [], 0, 0
        for us in sorted(ticks):
            while at < len(coming) and coming[at][0][0] <= us:     # an event at a tick's time goes before it
                queue += [coming[at][0][1]] * coming[at][1]
                at += 1
            event = queue[taken] if taken < len(queue) else None
            taken += event is not None
            out.append((key[0], us, ticks[us][2], ticks[us][0], ticks[us][1], event))
        queue = queue[taken:] + [e for (_, e), n in coming[at:] for _ in range(n)]
        if queue:
            self.pending.put([(e,) for e in queue])
        elif self.pending.exists():
            self.pending.clear()
        if untimed[2]:
            out.append((key[0], None, untimed[2], *untimed[:2], None))
        if out:
            yield pd.DataFrame(out, columns=["run", "us", "n_procs", "cpu", "mem_bytes", "event"]).astype({"us": "Int64"})

    def close(self) -> None:
        pass


def live_attach(readings: DataFrame, events: DataFrame, key: str = "run_key", ts: str = "ts") -> DataFrame:
    """J5 on arrival: ``(key, ts_us, n_procs, cpu, mem_bytes, event)``, a row for each tick.

    ``readings`` (cpu, mem_bytes) and ``events`` (event) arrive interleaved on one stream or
    two.  Readings of a run with one time make a tick; an event waits in its run's queue, over
    batches and restarts, until a tick takes it.  Within a batch the rows go in order of time,
    over batches in order of arrival, as a live queue does; a tick's readings come in one batch.
    Readings without a time are a tick of their own that takes no event; an event without one
    is never taken.
    """
    when = (F.coalesce(F.unix_micros(ts), F.lit(0)).alias("us"), F.col(ts).isNotNull().alias("timed"))
    rows = readings.select(key, *when, "cpu", "mem_bytes", F.lit(None).cast("string").alias("event"))
    more = events.select(key, *when, F.lit(None).cast("double").alias("cpu"),
                         F.lit(None).cast("double").alias("mem_bytes"), "event")
    kind = readings.schema[key].dataType.simpleString()
    done = rows.unionByName(more).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Queue(), outputMode="Append", timeMode="None",
        outputStructType=f"run {kind}, us bigint, n_procs bigint, cpu double, mem_bytes double, event string")
    return done.select(F.col("run").alias(key), F.col("us").alias("ts_us"), "n_procs", "cpu", "mem_bytes", "event")
