"""Streaming sources: a table (or folder of files) read as an unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table_path


def stream_table(spark: SparkSession, sf_dir: str, name: str,
                 columns: list[str] | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` as a stream.

    The schema comes from the file footer (a stream needs it up front); the
    glob filter keeps the other tables of the folder out of the stream.
    """
    static = spark.read.parquet(table_path(sf_dir, name))
    reader = (spark.readStream.schema(static.schema)
                   .option("pathGlobFilter", f"{name}.parquet"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(sf_dir)
    return df.select(*columns) if columns else df


def stream_folder(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A folder of Parquet files with the schema of ``like`` as a stream."""
    return spark.readStream.schema(like.schema).parquet(path)


def stream_text(spark: SparkSession, path: str, recursive: bool = False,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Text files under ``path`` as a stream of lines (``value``)."""
    reader = spark.readStream.format("text")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Cast an NTZ event time to TIMESTAMP (the session zone is UTC).

    ``withWatermark`` rejects TIMESTAMP_NTZ columns, so every event-time
    operator goes through this first.
    """
    return df.withColumn(column, F.col(column).cast("timestamp"))
