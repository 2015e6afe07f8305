"""Parquet table access.

Tables are read lazily with the columns an operator needs, so the parquet scan
shows a pruned ``ReadSchema`` and pushed filters; nothing is cached or
collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def split_session(spark: SparkSession, split_bytes: int) -> SparkSession:
    """A session whose file scans are cut into splits of ``split_bytes``.

    The split-count hint of a job (how many map tasks it wants) becomes the size
    of a split, as ``input bytes / wanted tasks``.  It is a reader setting: no row
    is shuffled, and the caller's own session keeps its setting.  Files and row
    groups that can't be cut any further stay one split.
    """
    if split_bytes < 1:
        raise ValueError("a split has at least one byte")
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(min(split_bytes, 4 << 20)))
    return own
