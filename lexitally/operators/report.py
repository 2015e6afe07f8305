"""Text report of the run analytics (built as string columns, written by a sink).

The report is one block per configuration plus a cumulative scalability table
that, after each core count, lists every speedup seen so far for the dataset.
Lines are produced on the executors from per-configuration rows; the cumulative
list is a running ``collect_list`` over them (one row per core count, partitioned
by dataset), never over raw rows.  It repeats earlier lines, so its size grows
with the square of the number of core counts, as the report itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import signed2

# The line formats of the run report (Python's ": .2f" is "% .2f").
SCALABILITY_HEADER = "**Scalability:** T₁ / T across core configurations"


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def scalability_lines(speedups: DataFrame) -> DataFrame:
    """Per (dataset, cores) its own line and the table so far."""
    w = (Window.partitionBy("dataset").orderBy("cores")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (speedups.withColumn("line", _line(_text("cores"), " cores: ", signed2("speedup"), "x"))
                    .withColumn("cumulative",
                                F.concat_ws("\n", F.lit(SCALABILITY_HEADER),
                                            F.array_join(F.collect_list("line").over(w), "\n"))))


def run_block(rows: DataFrame) -> DataFrame:
    """The steady-state block of one configuration.

    ``rows`` needs ``cores, avg_init_s, avg_cpu, avg_mem_mb, avg_runtime_s,
    throughput_words, throughput_mb, speedup``; a mean without samples counts 0.
    """
    lines = [
        _line("Initialization Overhead (no failures): ", signed2("avg_init_s"), " seconds"),
        _line(_text("cores"), " Cores (steady state):"),
        *_usage(""),
        _line("**Scalability:** ", signed2("speedup"), "x relative to 1 core"),
    ]
    return rows.withColumn("block", F.concat_ws("\n", *lines))


def _usage(prefix: str) -> list[Column]:
    def c(name: str) -> Column:
        return signed2(F.coalesce(F.col(prefix + name), F.lit(0.0)))
    return [
        _line("CPU Usage: ", c("avg_cpu"), " %"),
        _line("Memory Usage: ", c("avg_mem_mb"), " MB"),
        _line("RunTime: ", c("avg_runtime_s"), " seconds"),
        _line("**Throughput:** ", c("throughput_words"), " words/sec | ", c("throughput_mb"), " MB/sec"),
    ]


FAILURE_COLUMNS = ("avg_init_s", "avg_cpu", "avg_mem_mb", "avg_runtime_s", "throughput_words",
                   "throughput_mb", "avg_retry_s", "failure_reschedules")


def pair_summaries(summary: DataFrame) -> DataFrame:
    """J1 on per-configuration summaries: baseline rows with the failure columns ``f_*``.

    One grouped pass over the summary (a row per variant), no join.
    """
    of = {v: F.col("variant") == v for v in ("baseline", "failure")}
    return (summary.groupBy("dataset", "cores")
                   .agg(F.max(F.when(of["baseline"], F.col("avg_runtime_s"))).alias("baseline_runtime_s"),
                        *[F.max(F.when(of["failure"], F.col(c))).alias(f"f_{c}") for c in FAILURE_COLUMNS])
                   .where(F.col("baseline_runtime_s").isNotNull())
                   .withColumn("recovery_overhead_s", F.col("f_avg_runtime_s") - F.col("baseline_runtime_s")))


def failure_block(rows: DataFrame) -> DataFrame:
    """M5 + M6 + M8 + P11: the failure section, only for configurations that have one.

    ``rows`` needs the columns of :func:`pair_summaries` and ``failures``, the budget
    of the policy.  The last line shows the run's reschedules and is there only if
    there were any.
    """
    lines = [
        _line("Initialization Overhead (simulated core failure): ", signed2("f_avg_init_s"), " seconds"),
        _line(_text("cores"), " Cores with ", _text("failures"), " core failure(s):"),
        *_usage("f_"),
        _line("Total Execution Time (no failures): ", signed2("baseline_runtime_s"), " seconds"),
        _line("Total Execution Time (with failures): ", signed2("f_avg_runtime_s"), " seconds"),
        _line("Recovery Overhead: ", signed2("recovery_overhead_s"), " seconds"),
        _line("Measured Retry Overhead (time spent reprocessing): ", signed2("f_avg_retry_s"), " seconds"),
        F.when(F.col("f_failure_reschedules") > 0,
               _line("Rescheduled partitions (proxy for failed cores): ", _text("f_failure_reschedules"))),
    ]
    return (rows.where(F.col("f_avg_runtime_s").isNotNull())
                .withColumn("block", F.concat_ws("\n", *lines)))
