"""File sinks for word counts, result tables, time series and the report.

Write modes follow the experiment scripts: ``overwrite`` replaces an output
folder, ``errorifexists`` refuses to touch one (the MapReduce default),
``append`` adds files next to the existing ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators.wordcount import kv_lines, reducer_sorted


def write_word_counts(freq: DataFrame, path: str, n_files: int | None,
                      mode: str = "errorifexists") -> None:
    """IO7 + S1: ``word<TAB>count`` text, ``n_files`` files hash-partitioned by
    word and sorted inside each file.

    ``n_files=None`` keeps the aggregate's own hash partitioning on ``word``
    as the reducer layout (one shuffle): for a session whose shuffle width is
    the wanted file count and whose AQE coalescing is off, as
    ``reducer_session`` sets up.
    """
    if n_files:
        freq = freq.repartition(n_files, "word")
    kv_lines(reducer_sorted(freq)).write.mode(mode).text(path)


def reducer_session(spark, n_files: int) -> None:
    """Make the next per-word aggregation shuffle into exactly ``n_files``
    hash partitions (the reducers), so no second shuffle is needed.  Only for
    a session the caller owns (a job's own session, not a shared one)."""
    spark.conf.set("spark.sql.shuffle.partitions", str(n_files))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def write_table_csv(df: DataFrame, path: str, columns: list[str],
                    mode: str = "overwrite") -> None:
    """IO10 / IO11: CSV with a header and a fixed column order.

    ``overwrite`` rewrites the whole result (after each success); ``append``
    adds the new rows as new files, each with its own header line.
    """
    (df.select(*columns).write.mode(mode)
       .option("header", "true").csv(path))


def write_series(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "cores"),
                 mode: str = "overwrite") -> None:
    """IO12: one time-series CSV folder per (dataset, cores); NULL → empty cell."""
    (df.write.mode(mode).partitionBy(*by)
       .option("header", "true").option("nullValue", "").csv(path))


def write_report(lines: DataFrame, path: str, column: str = "block",
                 mode: str = "overwrite") -> None:
    """IO13: text report; ``overwrite`` starts it, ``append`` adds blocks."""
    lines.select(F.col(column).alias("value")).write.mode(mode).text(path)


def ingest(df: DataFrame, path: str, partition_by: str | None = "dataset",
           mode: str = "append") -> None:
    """IO6: put rows into a shared input location unconditionally."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def replace_datasets(df: DataFrame, path: str, key: str = "dataset") -> None:
    """IO8 for one dataset of many: the datasets that ``df`` holds are replaced whole (a half
    loaded one, too); the files of all others stay as they are (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(key).parquet(path))


def ingest_missing(df: DataFrame, path: str, key: str = "dataset") -> None:
    """IO5 + J7: append only the datasets the target does not hold yet.

    A dataset that is present at all counts as present (even if incomplete),
    as with a per-folder existence test.  The target's key listing is taken
    when the plan is built, so the append does not see its own rows.
    """
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(path).select(key).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":     # no target yet: everything is new
            raise
        new = df
    else:
        new = df.join(existing, key, "left_anti")
    new.write.mode("append").partitionBy(key).parquet(path)
