"""Sampling and partition layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_key(key: str | Column, seed: str) -> Column:
    """A repeatable pseudo-random sort key: md5 of the key and a seed."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(seed)))


def sample_k(df: DataFrame, key: str, k: int, seed: str = "42") -> DataFrame:
    """S4 + F7: uniform k-of-n sample without replacement, ``min(k, n)`` rows.

    A top-k on a hash of the key: each task keeps its own k best rows and only
    those reach the final merge (``TakeOrderedAndProject``), so the driver and
    the final task see at most ``k * tasks`` rows whatever n is.  ``k`` is meant to
    be small: the k rows of the result are merged in one task.
    """
    if k <= 0:
        return df.limit(0)
    return (df.withColumn("sample_key", sample_key(key, seed))
              .orderBy("sample_key", key)
              .limit(k))


def partition_profile(df: DataFrame) -> DataFrame:
    """S6 + X3: rows per partition of ``df`` as laid out now (a skew profile)."""
    return (df.groupBy(F.spark_partition_id().alias("partition_id"))
              .agg(F.count(F.lit(1)).alias("n_rows")))


def bucket_profile(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per key bucket (``key mod n``): the layout a job would get that
    deals rows by this key, whatever the layout of the files."""
    return (df.groupBy(F.pmod(F.col(key), F.lit(n)).cast("int").alias("partition_id"))
              .agg(F.count(F.lit(1)).alias("n_rows")))


def key_ranges(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` in ``n`` partitions of equally wide ranges of a whole-number key, in order of the key.

    The layout is fixed by the smallest and largest key alone: partition i holds the keys
    whose place between them falls in the i-th of n parts; rows without a key are in the first.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.repartitionById(n, F.lit(0))
    width = (high - low) // n + 1
    return df.repartitionById(n, F.coalesce(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(0)).cast("int"))


def map_partitions_with_index(df: DataFrame, fn: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                              schema: str) -> DataFrame:
    """``fn(index, batches)`` once for each partition that has rows, Arrow batches in and out."""
    def run(batches):
        yield from fn(TaskContext.get().partitionId(), batches)
    return df.mapInArrow(run, schema)


PROFILE_SCHEMA = "partition_id int, n_rows bigint, first_key bigint, last_key bigint, n_bytes bigint"


def profile_with_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """X3 + S6: index, rows, smallest and largest key and UTF-8 bytes of each partition that has rows."""
    def profile(index, batches):
        import pyarrow.compute as pc
        rows, size, low, high = 0, 0, None, None
        for batch in batches:
            rows += batch.num_rows
            size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            ends = pc.min_max(batch.column(0)).as_py()
            if ends["min"] is not None:
                low = ends["min"] if low is None else min(low, ends["min"])
                high = ends["max"] if high is None else max(high, ends["max"])
        if rows:
            values = (index, rows, low, high, size)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                             ["partition_id", "n_rows", "first_key", "last_key", "n_bytes"])
    return map_partitions_with_index(df.select(key, text), profile, PROFILE_SCHEMA)
