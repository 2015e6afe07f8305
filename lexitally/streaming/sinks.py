"""Streaming sinks.

``run_upserts`` drives a stream and writes each micro-batch's rows to
``<out>/batch_id=<n>`` with overwrite: an aggregating stream in *update* mode gives
its changed rows, and ``per_batch`` may aggregate a batch first.  A batch replayed
after a failure (same id, from the checkpoint's offset log) rewrites its own
folder, so the log is exactly-once; ``latest_rows`` folds the log into the current
value per key (the row of the highest batch id).

``run_append`` is the plain append-mode file sink for row-wise (non
aggregating) streams: results are written as they arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_COL = "batch_id"


def _batch_writer(out: str, per_batch: Callable[[DataFrame], DataFrame] | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        if per_batch:
            batch = per_batch(batch)
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH_COL}={batch_id}")
    return write


def run_upserts(df: DataFrame, out: str, checkpoint: str,
                available_now: bool = True, query_name: str | None = None,
                per_batch: Callable[[DataFrame], DataFrame] | None = None):
    """Start an update-mode stream into the batch log; wait when bounded."""
    writer = (df.writeStream.outputMode("update")
                .foreachBatch(_batch_writer(out, per_batch))
                .option("checkpointLocation", checkpoint))
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def read_log(spark: SparkSession, out: str, schema_hint: DataFrame | None = None) -> DataFrame:
    """The batch log; with ``schema_hint``, a log that no batch has begun is empty."""
    try:
        return spark.read.parquet(out)
    except AnalysisException as e:
        if schema_hint is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema_hint.schema).withColumn(BATCH_COL, F.lit(0))


def latest_rows(spark: SparkSession, out: str, keys: list[str],
                schema_hint: DataFrame | None = None) -> DataFrame:
    """Current value per key: the row of the highest batch id.

    One aggregate with partial results, so a key that changes in every batch
    costs a row per task.  A key has one row per batch.
    """
    log = read_log(spark, out, schema_hint)
    values = [c for c in log.columns if c not in keys and c != BATCH_COL]
    return log.groupBy(*keys).agg(*[F.max_by(c, BATCH_COL).alias(c) for c in values])


def state_rows(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """``(key, value, partition_id)``: an aggregating stream's state as its checkpoint holds it
    after ``batch_id`` (the last batch, if not given)."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", str(batch_id))
    return reader.load(checkpoint)


def run_append(df: DataFrame, out: str, checkpoint: str, fmt: str = "parquet",
               available_now: bool = True, options: dict[str, str] | None = None):
    """Append-mode file sink (T4): each batch adds files, exactly once."""
    writer = (df.writeStream.outputMode("append").format(fmt)
                .option("path", out).option("checkpointLocation", checkpoint))
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    if available_now:
        writer = writer.trigger(availableNow=True)
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
