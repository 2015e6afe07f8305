"""Text datasets on files: line scans, dataset tagging, byte totals.

A dataset is a named folder of text files.  ``read_lines`` is the one-level
scan (a missing path raises ``AnalysisException``); ``recursive=True`` walks
sub-folders like the MapReduce input format.  Files whose names start with
``_`` or ``.`` are hidden from both scans (Hadoop's hidden-file rule), and
``dataset_bytes`` lists files with the same rule and takes the same ``recursive``
flag, so throughput numerator and denominator describe the same files if both
get the same one.  ``\\n``, ``\\r\\n`` and ``\\r`` all end
a line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """IO1 / IO2: one row per line, column ``value``."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.text(path)


def read_dataset(spark: SparkSession, root: str, name: str,
                 recursive: bool = False) -> DataFrame:
    """IO1 + IO3: the lines of the dataset called ``name`` under ``root``
    (a missing dataset raises ``AnalysisException``)."""
    return read_lines(spark, f"{root.rstrip('/')}/{name}", recursive)


def _strip_scheme(path: str) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def dataset_of(file_path: Column, root: str, encoded: bool = True) -> Column:
    """The first folder below ``root`` in a file path; '' for a loose file.

    ``_metadata.file_path`` is URI-encoded (a blank is ``%20``), ``root`` and the
    binary-file source's ``path`` are not; a plus sign stands for itself in a path.
    """
    plain = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B"))) if encoded else file_path
    pat = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?" + re.escape(_strip_scheme(root)) + r"/([^/]+)/"
    return F.regexp_extract(plain, pat, 1)


def read_datasets(spark: SparkSession, root: str) -> DataFrame:
    """IO3: lines of every dataset folder under ``root`` as ``(dataset, value)``.

    Loose files directly under ``root`` belong to no dataset and are skipped.
    """
    lines = read_lines(spark, root, recursive=True)
    return (lines.select(dataset_of(F.col("_metadata.file_path"), root).alias("dataset"),
                         "value")
                 .where(F.col("dataset") != ""))


def dataset_bytes(spark: SparkSession, root: str, by_dataset: bool = True,
                  recursive: bool = True) -> DataFrame:
    """IO4 + A7: total file bytes, from a listing that reads no file content.

    ``recursive`` as for ``read_lines``; totals by dataset need it, as a dataset is
    a folder below ``root``.

    Only ``length`` (and ``path``) are selected from the binary-file source,
    so the scan's ReadSchema carries no ``content`` column.
    """
    reader = spark.read.format("binaryFile")
    if recursive or by_dataset:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(root)
    if not by_dataset:
        return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
                         .alias("dataset_bytes"))
    return (files.select(dataset_of(F.col("path"), root, encoded=False).alias("dataset"), "length")
                 .where(F.col("dataset") != "")
                 .groupBy("dataset")
                 .agg(F.sum("length").cast("bigint").alias("dataset_bytes")))
