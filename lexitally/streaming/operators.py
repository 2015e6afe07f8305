"""Event-time operators for streams (they also accept batch DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import event_time


def tumbling_stats(df: DataFrame, ts: str = "ts", size: str = "1 hour",
                   by: tuple[str, ...] = (), value: str = "value",
                   watermark: str | None = "10 minutes") -> DataFrame:
    """Count and mean of ``value`` per tumbling window (and ``by`` keys).

    With a watermark (max event time seen minus ``watermark``) a window's
    state is evicted once the watermark passes the window's end, so the state
    is bounded by the open windows.  Input rows older than the previous
    batch's watermark are dropped; rows no later than ``watermark`` behind the
    maximum are always counted.  Because eviction uses the current watermark
    and dropping the previous one, no row can reach a window after it was
    evicted: each window's updates come from one state lifetime, which is
    what the latest-row fold of the update log relies on.
    """
    df = event_time(df, ts)
    if watermark:
        df = df.withWatermark(ts, watermark)
    return (df.groupBy(F.window(ts, size).alias("w"), *by)
              .agg(F.count(F.lit(1)).alias("n"),
                   F.sum(value).alias("sum_value"))
              .select(F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"), *by, "n",
                      (F.col("sum_value") / F.col("n")).alias("avg_value")))
