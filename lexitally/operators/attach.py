"""J5 + W5: attach each pending event to the next sample (FIFO, one per sample).

The sampler pops at most one queued event per tick, so with events and ticks
of one run ordered by time (an event at a tick's own timestamp goes to that
tick), the k-th event lands on tick number

    s_idx(k) = k + max_{j <= k} (s_before(j) + 1 - j)

where ``s_before(j)`` counts the ticks strictly before event j.  Events whose
``s_idx`` exceeds the run's tick count are never attached (the sampler
stopped first).

Everything above is a prefix computation (counts and a running max) along
each run's time line.  A plain ``Window.partitionBy(run_key)`` would put a run
holding a third of all rows into one task, so the scan is done in two levels:

1. equal events (same run, time and text) become one row with a count, before
   any shuffle of theirs is sorted;
2. the time line is cut into buckets of a fixed width of time, a pure function
   of the row; a window per ``(run, bucket)`` computes local counts and the
   local running max.  A bucket's rows are bounded by its width over the
   sampling interval, however long the run is;
3. a summary with one row per ``(run, bucket)`` gets exclusive prefix sums and a
   prefix max with a window per run over its buckets;
4. local values plus the bucket's carried offsets give the global tick rank
   and ``s_idx``; an equi-join on ``(run, rank)`` attaches the event.

The line is exchanged twice: by (run, bucket), then by (run, rank).  Run keys may
be NULL; ticks and events without a run key form one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, EVENT = 1, 0  # kind: an event sorts before a tick with the same time
BUCKET_SECONDS = 86400


def time_bucket(ts: Column, dtype: str, width: int) -> Column:
    """Number of the bucket that a time falls in; plain numbers count as seconds."""
    if dtype.startswith("timestamp"):
        return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(width * 1_000_000))
    return F.floor(ts / F.lit(width))


def bucketed_scan(ticks: DataFrame, events: DataFrame, key: str = "run_key",
                  ts: str = "ts", event: str = "event",
                  bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Steps 1-2: the merged time line with local prefix values.

    Columns ``k, t, kind, ev, m, <tick payload>, bucket, ls, le, lv, lmax``; ``m`` is
    how many equal events a row stands for, ``le`` counts up to its last one.
    """
    payload = [c for c in ticks.columns if c not in (key, ts)]
    once = (events.groupBy(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(event).cast("string").alias("ev"))
                  .agg(F.count(F.lit(1)).alias("m")))
    # Tick payload rides along the time line (NULL on event rows), so the
    # result needs no join back to ``ticks``.
    line = (ticks.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.lit(SAMPLE).alias("kind"),
                         F.lit(None).cast("string").alias("ev"), F.lit(0).cast("bigint").alias("m"), *payload)
            .unionByName(once.select("k", "t", F.lit(EVENT).alias("kind"), "ev", "m"),
                         allowMissingColumns=True))
    line = line.withColumn("bucket", time_bucket(F.col("t"), dict(line.dtypes)["t"], bucket_seconds))
    w = (Window.partitionBy("k", "bucket").orderBy("t", "kind", "ev")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (line.withColumn("ls", F.sum(F.col("kind").cast("bigint")).over(w))
                .withColumn("le", F.sum("m").over(w))
                # the first of the m equal events decides: later ones have smaller values
                .withColumn("lv", F.when(F.col("kind") == EVENT, F.col("ls") - F.col("le") + F.col("m")))
                .withColumn("lmax", F.max("lv").over(w)))


def attach_events(ticks: DataFrame, events: DataFrame, key: str = "run_key",
                  ts: str = "ts", event: str = "event",
                  bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Return ``ticks`` with a nullable ``event`` column (FIFO attachment).

    ``ticks`` must have one row per ``(key, ts)`` (see ``tick_totals``).
    """
    payload = [c for c in ticks.columns if c not in (key, ts)]
    local = bucketed_scan(ticks, events, key, ts, event, bucket_seconds)
    w_prev = (Window.partitionBy("k").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    summary = (local.groupBy("k", "bucket")
                    .agg(F.max("ls").alias("cs"), F.max("le").alias("ce"),
                         F.max("lv").alias("cmax"))
                    .withColumn("s0", F.coalesce(F.sum("cs").over(w_prev), F.lit(0)))
                    .withColumn("e0", F.coalesce(F.sum("ce").over(w_prev), F.lit(0)))
                    .withColumn("gmax", F.col("s0") - F.col("e0") + F.col("cmax"))
                    .withColumn("pmax", F.max("gmax").over(w_prev))
                    .select(F.col("k").alias("k2"), F.col("bucket").alias("b2"), "s0", "e0", "pmax"))

    placed = local.join(summary, F.col("k").eqNullSafe(F.col("k2"))
                        & F.col("bucket").eqNullSafe(F.col("b2")))
    tick_rank = (placed.where(F.col("kind") == SAMPLE)
                       .select("k", "t", *payload,
                               (F.col("s0") + F.col("ls")).alias("rank")))
    first = F.col("e0") + F.col("le") - F.col("m") + 1           # number of the row's first event
    reach = F.greatest(F.col("pmax"), F.col("s0") - F.col("e0") + F.col("lmax"))
    event_slot = (placed.where(F.col("kind") == EVENT)
                        .select(F.col("k").alias("ek"), "ev",
                                F.explode(F.sequence(first + reach, first + reach + F.col("m") - 1)).alias("slot")))
    return (tick_rank.join(event_slot, F.col("k").eqNullSafe(F.col("ek")) & (F.col("rank") == F.col("slot")), "left")
                     .select(F.col("k").alias(key), F.col("t").alias(ts), *payload,
                             F.col("ev").alias(event)))
