"""Result tables written by earlier experiments (CSV with a header).

Header spellings differ for the same quantities, and files of several spellings
may share a folder.  ``read_results`` deals the files by their header and scans the
files of each spelling as CSV with an explicit schema under one set of names, so no
row is shuffled to find its header.  Cells may be quoted and hold line breaks.  A
malformed row keeps what could be read of it and shows its text in ``bad_record``.
Memory was recorded in two units, which stay two columns: MB of the process
(``memory usage``, and ``avg_mem`` in files of the Spark job) and percent of the host
(``avg_mem`` beside ``sort_mb``, in files of the MapReduce job).
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "bad_record"

# Header spellings found in the published result files.
HEADER_NAMES = {
    "dataset": "dataset", "Dataset": "dataset", "Data set": "dataset",
    "cores": "cores", "Cores": "cores",
    "sort_mb": "sort_mb",
    "runtime_seconds": "runtime_seconds", "runtime": "runtime_seconds",
    "avg_cpu": "avg_cpu", "cpu usage": "avg_cpu",
    "avg_mem": "avg_mem_mb", "memory usage": "avg_mem_mb",      # avg_mem beside sort_mb is percent
    "throughput_words_per_sec": "throughput_words_per_sec", "throughput": "throughput_words_per_sec",
    "speedup_vs_1_core": "speedup_vs_1_core", "scalability": "speedup_vs_1_core",
    "initialization overhead": "init_overhead_s",
    "Num Failures": "failures",
    "Executor Memory": "executor_memory",
    "total_words": "total_words",
    "baseline_time": "baseline_time",
    "parallel_efficiency": "parallel_efficiency",
    "outcome": "outcome",
}

TYPES = {
    "dataset": "string", "cores": "int", "sort_mb": "int", "runtime_seconds": "double",
    "avg_cpu": "double", "avg_mem_percent": "double", "avg_mem_mb": "double", "throughput_words_per_sec": "double",
    "speedup_vs_1_core": "double", "init_overhead_s": "double", "failures": "int",
    "executor_memory": "string", "total_words": "bigint", "baseline_time": "double",
    "parallel_efficiency": "double", "outcome": "string",
}


def canonical_names(header: list[str]) -> list[str]:
    """Names of a header's cells; the unit of memory is read from the whole header."""
    names = [HEADER_NAMES.get(c.strip(), c.strip().lower().replace(" ", "_")) for c in header]
    if "sort_mb" in names:
        names = ["avg_mem_percent" if c.strip() == "avg_mem" else n for c, n in zip(header, names)]
    return names


def files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files below ``path``, by header line.

    A header is a line whose cells are all known column names.  One row a file comes to the
    driver, as from any listing.  A file with rows but no header, or with two different ones,
    is an error that names it.
    """
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(place.alias("file"), F.trim("value").alias("value")).where("value <> ''")
    known = F.array(*[F.lit(n) for n in HEADER_NAMES])
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    header = F.when(F.forall(cells, lambda c: F.array_contains(known, c)), F.col("value"))
    found = (lines.select("file", header.alias("header")).groupBy("file")
             .agg(F.min("header").alias("header"), F.max("header").alias("other")).orderBy("file").collect())
    if wrong := [r["file"] for r in found if r["header"] is None or r["header"] != r["other"]]:
        raise ValueError(f"{len(wrong)} files without one known header, the first: {wrong[:3]}")
    if not found:
        raise ValueError(f"no known result header below {path}")
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r["header"], []).append(r["file"])
    return out


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """IO14: result CSVs below ``path`` with canonical column names and types, and ``bad_record``:
    the text of a row that does not fit its header or types, else NULL.

    One CSV scan a spelling; the results are a union without a shuffle.
    """
    out = None
    for header, files in files_by_header(spark, path).items():
        names = canonical_names(next(csv.reader([header])))
        ddl = ", ".join(f"`{n}` {TYPES.get(n, 'string')}" for n in names)
        part = (spark.read.schema(f"{ddl}, `{BAD}` string")
                .option("header", "true").option("enforceSchema", "true").option("multiLine", "true")
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("columnPruning", "false")
                .option("escape", '"').option("ignoreLeadingWhiteSpace", "true")
                .option("ignoreTrailingWhiteSpace", "true").csv(files))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
