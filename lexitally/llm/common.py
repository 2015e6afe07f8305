"""Shared helpers: table access, written intermediate tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table

CHUNK_BYTES = 4 << 20       # operators hand results back to Spark in pieces of about this size

WORD_PATTERN = rb"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, name, cols or None)


def written(df: DataFrame, name: str, compression: str | None = None, **options) -> DataFrame:
    """Write ``df`` below the shared folder (``options``: of Spark's writer) and read it back.

    Cuts the lineage: a lost executor costs a reread, not the work before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    df.write.options(**options).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver find that finished steps' shuffle files are no longer needed.

    Spark deletes them when the driver's collector has found their handles
    unused; a driver with little garbage may not look for a long time.  Python goes
    first: its objects hold the JVM's plans and broadcasts.  What both free goes
    back to the system.
    """
    gc.collect()
    trim_memory()
    spark.sparkContext._jvm.System.gc()


def trim_memory() -> None:
    """Give memory that Python and Arrow have freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (``bytes.split`` splits on just these)."""
    return text.encode("utf-8", "surrogatepass").split()


def masked_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with neutral column names, and {neutral name: own name}.

    Operators add columns of their own; a stage that carries all columns of its
    input through one masks their names first.
    """
    names = {f"_in{i}": c for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(m) for m, c in names.items()]), names


def names_of(names: dict[str, str], own: str) -> str:
    """The neutral name of a column."""
    return next(m for m, c in names.items() if c == own)


def split_key(name: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id gives 0 (never held out)."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3, F.lit(0))


class Chunks:
    """Collects rows by column and yields record batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = CHUNK_BYTES):
        self.schema, self.limit = schema, limit
        self._new()

    def _new(self):
        self.cols = [[] for _ in self.schema]
        self.size = 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        for col, value in zip(self.cols, row):
            col.append(value)
        self.size += size
        if self.size >= self.limit:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(self.cols, self.schema)], schema=self.schema)
        self._new()
        return batch

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.cols[0]:
            yield self.flush()
        pa.default_memory_pool().release_unused()          # the worker lives on beside the JVM


def frugal(scan):
    """``scan`` for mapInArrow, which at the end of a task gives back what its tables and buffers held.

    Spark keeps the worker for later tasks, beside the JVM; without this its allocator keeps
    the pages, too.
    """
    def task(batches):
        yield from scan(batches)               # its tables are freed with it
        trim_memory()

    return task


@contextlib.contextmanager
def no_cycle_search():
    """A task that builds large tables and no reference cycles: Python need not look for any."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch as Python values, a few at a time (texts may be long)."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for start in range(0, batch.num_rows, 64):
        yield from zip(*[c.slice(start, 64).to_pylist() for c in cols])


_kept: dict[tuple[str, str], tuple[int, object]] = {}


def keep_only(owner: str) -> None:
    """Free what operators other than ``owner`` keep in this Python worker between tasks."""
    if any(o != owner for o, _ in _kept):
        _kept.clear()


def worker_object(owner: str, kind: str, ident: int, build):
    """An operator's object in this Python worker, built anew for each broadcast ``ident``.

    One of a kind is kept between tasks, until another operator's task comes.
    """
    keep_only(owner)
    if _kept.get((owner, kind), (None,))[0] != ident:
        _kept.pop((owner, kind), None)
        _kept[owner, kind] = ident, build()
    return _kept[owner, kind][1]


# ------------------------------------------------------------ 64-bit mixing
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array (wraps around by design)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))
