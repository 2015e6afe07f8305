"""Registered streaming queries.

Each takes a table in PARTS parts, in order of time by whole days (or by id, where
there is no time).  A part arrives, the stream is started with
``trigger(availableNow=True)`` on the same checkpoint, takes what is new, and stops;
then the next part arrives.  So every query restarts once and depends on its restored
state.  The result is returned as a batch DataFrame; the queries run whole while they
are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch_micros, rounded
from ..functions.tokenize import LETTERS
from ..operators import runs as R
from ..operators import wordcount as W
from ..plans import fixtures as FX
from ..plans.catalog import ORACLE, _ALPHA_FREQ
from ..session import scratch_path
from ..sources.tables import read_table
from . import sinks, stateful
from .operators import tumbling_stats
from .sources import event_time, stream_folder

WINDOW = "1 hour"
WATERMARK = "10 minutes"


PARTS = 2


def _time_parts(events: DataFrame) -> list:
    """Conditions that cut the table into PARTS pieces of as many days, in order."""
    day = F.floor(epoch_micros("ts") / F.lit(86_400_000_000))
    low, high = events.agg(F.min(day), F.max(day)).first()
    if low is None:
        return [F.lit(True)]
    step = (high - low) // PARTS + 1
    part = F.floor((day - F.lit(low)) / F.lit(step))
    return [F.coalesce(part, F.lit(0)) == i for i in range(PARTS)]   # without a time: in the first


def _run_parts(spark: SparkSession, name: str, table: DataFrame, parts: list, start) -> str:
    """Let the parts of ``table`` arrive one by one; ``start(stream, out, checkpoint)`` runs
    the query over what is new.  Returns the folder of results."""
    base = scratch_path(spark, "streams", name)
    for part in parts:
        table.where(part).write.mode("append").parquet(f"{base}/in")
        start(stream_folder(spark, f"{base}/in", table), f"{base}/out", f"{base}/checkpoint")
    return f"{base}/out"


def _all_windows(spark: SparkSession, out: str, table: DataFrame, keys: list[str], value: str,
                 view=lambda stream: stream) -> DataFrame:
    """The log's windows, and the rows without a time: a window takes none of them, so a stream
    of their own over what has arrived counts them, with null for the window."""
    base = out.removesuffix("/out")
    rows = view(stream_folder(spark, f"{base}/in", table)).where("ts is null")
    nowhen = F.lit(None).cast("timestamp")
    sinks.run_upserts(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum_value"))
        .select(nowhen.alias("window_start"), nowhen.alias("window_end"), *keys, "n",
                (F.col("sum_value") / F.col("n")).alias("avg_value")),
        f"{base}/untimed", f"{base}/untimed-checkpoint")
    keys = ["window_start", "window_end", *keys]
    return sinks.latest_rows(spark, out, keys).unionByName(sinks.latest_rows(spark, f"{base}/untimed", keys))


def _events(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return event_time(read_table(spark, d, "events", list(cols)))


def q_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly count / mean value per event type, watermarked."""
    ev = _events(spark, d, "ts", "event_type", "value")
    out = _run_parts(spark, "tumbling", ev, _time_parts(ev), lambda stream, out, ckpt: sinks.run_upserts(
        tumbling_stats(stream, "ts", WINDOW, ("event_type",), "value", WATERMARK), out, ckpt))
    res = _all_windows(spark, out, ev, ["event_type"], "value")
    return res.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "event_type", "n", rounded("avg_value").alias("avg_value"))


SAMPLE_WINDOW = "1 day"


def q_stream_sample_windows(spark: SparkSession, d: str) -> DataFrame:
    """T1 + A3: resource samples of each run averaged per tumbling window."""
    ev = _events(spark, d, "event_id", "ts", "user_id", "event_type", "value")
    out = _run_parts(spark, "sample_windows", ev, _time_parts(ev), lambda stream, out, ckpt: sinks.run_upserts(
        # samples carry the start of their day: the watermark allows for it
        tumbling_stats(FX.samples(stream), "ts", SAMPLE_WINDOW, ("run_key",), "cpu", "2 days"), out, ckpt))
    res = _all_windows(spark, out, ev, ["run_key"], "cpu", FX.samples)
    return res.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "run_key", F.col("n").alias("n_samples"),
                      rounded("avg_value").alias("avg_cpu"))


def q_stream_first_crossing(spark: SparkSession, d: str) -> DataFrame:
    """First sample per run at or above 50 % progress, as samples arrive.

    The rows are the stream's own output: a latch in the state lets each run fire once.
    """
    own = stateful.state_session(spark)
    ev = _events(own, d, "event_id", "ts", "user_id", "event_type", "value")
    out = _run_parts(own, "first_crossing", ev, _time_parts(ev), lambda stream, out, ckpt: sinks.run_append(
        stateful.first_crossings(FX.samples(stream), 50.0), out, ckpt))
    return spark.read.parquet(out).select("run_key", "first_ts_us", F.col("value_at").alias("progress_at"))


def q_stream_attach_events(spark: SparkSession, d: str) -> DataFrame:
    """Pending events wait in their run's queue on the stream until a tick takes them."""
    own = stateful.state_session(spark)
    ev = _events(own, d, "event_id", "ts", "user_id", "event_type", "value")
    out = _run_parts(own, "attach", ev, _time_parts(ev), lambda stream, out, ckpt: sinks.run_append(
        stateful.live_attach(FX.samples(stream), FX.triggers(stream)), out, ckpt))
    return spark.read.parquet(out).select("run_key", "ts_us", "n_procs", rounded("cpu").alias("cpu"),
                                          rounded("mem_bytes").alias("mem_bytes"), "event")


def _doc_parts(n: int = PARTS) -> list:
    """Conditions that cut the documents into ``n`` pieces by id; those without one are in the first."""
    return [F.coalesce(F.pmod("doc_id", F.lit(n)), F.lit(0)) == i for i in range(n)]


def q_stream_wordcount(spark: SparkSession, d: str) -> DataFrame:
    """Letter-rule word counts kept as streaming state (update mode) over several batches."""
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    out = _run_parts(spark, "wordcount", docs, _doc_parts(), lambda stream, out, ckpt: sinks.run_upserts(
        W.word_freq(stream, "text", LETTERS), out, ckpt))
    return sinks.latest_rows(spark, out, ["word"])


def q_stream_wordcount_restart(spark: SparkSession, d: str) -> DataFrame:
    """Words per language; stopped and started again, the counts go on from the checkpoint,
    and a start without new input changes nothing."""
    docs = read_table(spark, d, "documents", ["doc_id", "lang", "text"])
    even, odd = _doc_parts(2)
    parts = [even, F.lit(False), odd, F.lit(False)]
    out = _run_parts(spark, "restart", docs, parts, lambda stream, out, ckpt: sinks.run_upserts(
        W.dataset_words(stream, "lang", "text", LETTERS), out, ckpt))
    return sinks.latest_rows(spark, out, ["dataset"])


def q_stream_wordcount_state(spark: SparkSession, d: str) -> DataFrame:
    """The word counts in the state itself, read from the checkpoint by the state-store reader:
    as the first start left them, and after the restart with the other documents."""
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    seen = []

    def start(stream, out, ckpt):
        sinks.run_upserts(W.word_freq(stream, "text", LETTERS), out, ckpt)
        seen.append((ckpt, sinks.read_log(spark, out).agg(F.max(sinks.BATCH_COL)).first()[0]))

    _run_parts(spark, "state", docs, _doc_parts(2), start)
    points = [sinks.state_rows(spark, ckpt, batch).select(F.lit(i).alias("start"), "key.word", F.col("value.count").alias("n"))
              for i, (ckpt, batch) in enumerate(seen, 1) if batch is not None]
    return points[0] if len(points) == 1 else points[0].unionByName(points[1])


def q_stream_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """T4: failure-test outcomes appended to a file sink as runs arrive."""
    ev = _events(spark, d, "event_id", "ts", "user_id", "event_type", "value")
    out = _run_parts(spark, "outcomes", ev, _time_parts(ev), lambda stream, out, ckpt: sinks.run_append(
        R.outcomes(R.with_durations(FX.runs(stream))), out, ckpt))
    return spark.read.parquet(out).select(
        "run_id", "dataset", "cores", rounded("runtime_s").alias("runtime_s"),
        "outcome", "label")


STREAM_QUERIES = {
    "q_stream_tumbling": q_stream_tumbling,
    "q_stream_sample_windows": q_stream_sample_windows,
    "q_stream_first_crossing": q_stream_first_crossing,
    "q_stream_wordcount": q_stream_wordcount,
    "q_stream_wordcount_restart": q_stream_wordcount_restart,
    "q_stream_outcomes": q_stream_outcomes,
    "q_stream_attach_events": q_stream_attach_events,
    "q_stream_wordcount_state": q_stream_wordcount_state,
}

STREAM_ORACLE = {
    "q_stream_tumbling": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS avg_value
FROM events GROUP BY 1, 2""",
    "q_stream_sample_windows": """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       user_id AS run_key, CAST(count(*) AS BIGINT) AS n_samples,
       round(avg(value), 6) AS avg_cpu
FROM events WHERE event_type <> 'error' GROUP BY 1, 2""",
    "q_stream_first_crossing": ORACLE["q_first_crossing"],
    "q_stream_wordcount": _ALPHA_FREQ,
    "q_stream_wordcount_restart": ORACLE["q_dataset_words"],
    "q_stream_outcomes": ORACLE["q_outcomes"],
    "q_stream_attach_events": ORACLE["q_attach_events"],
    "q_stream_wordcount_state": f"""
SELECT 1 AS start, word, n FROM ({_ALPHA_FREQ.replace("FROM documents", "FROM documents WHERE coalesce(abs(doc_id) % 2, 0) = 0")}) a
UNION ALL SELECT 2 AS start, word, n FROM ({_ALPHA_FREQ}) b""",
}
