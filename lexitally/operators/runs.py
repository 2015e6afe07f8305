"""Run analytics: resource averages, per-configuration summaries, speedup,
parallel efficiency, recovery overhead, outcomes and threshold crossings.

Every operator aggregates before it windows or joins: raw samples and runs are
reduced with partial (map-side) aggregation, so a run key or configuration
that holds a third of all rows costs one partial row per task.  Windows only
ever run over per-configuration rows, partitioned by dataset.  Joins against
derived per-dataset facts and the failure policy are plain joins: Spark broadcasts
a side whose size (by statistics when planning, by measurement under AQE) is
below its threshold, and shuffles beyond it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import MB, safe_ratio, seconds_between

# Outcome labels and run-label formats of the experiment scripts.
OUTCOME_OK = "Recovered"
OUTCOME_FAILED = "Failed"
RUN_LABEL_FORMAT = "%s_%dcores_%dmb"      # {dataset}_{cores}cores_{sort_mb}mb
FAILURE_LABEL_FORMAT = "%s_%dc_FT"        # {dataset}_{cores}c_FT


# ---------------------------------------------------------------- samples
def tick_totals(samples: DataFrame, key: str = "run_key", ts: str = "ts") -> DataFrame:
    """Sum the readings of all processes sampled at the same tick.

    Disk counters, where the samples have them, are the host's: the largest
    reading of the tick.
    """
    disk = [F.max(c).alias(c) for c in ("disk_read", "disk_write") if c in samples.columns]
    return (samples.groupBy(key, ts)
                   .agg(F.sum("cpu").alias("cpu"),
                        F.sum("mem_bytes").alias("mem_bytes"),
                        F.count(F.lit(1)).alias("n_procs"), *disk))


def run_means(ticks: DataFrame, key: str = "run_key") -> DataFrame:
    """A3 + F6: mean cpu and mean memory (MB) of each run's ticks."""
    return (ticks.groupBy(key)
                 .agg(F.count(F.lit(1)).alias("n_ticks"),
                      F.avg("cpu").alias("avg_cpu"),
                      (F.avg("mem_bytes") / F.lit(MB)).alias("avg_mem_mb")))


def mean_of_means(per_run: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """A4: unweighted mean across runs of per-run values (not a pooled mean)."""
    return (per_run.groupBy(*by)
                   .agg(F.count(F.lit(1)).alias("n_runs"),
                        *[F.avg(c).alias(c) for c in cols]))


def with_fallback(keys: DataFrame, means: DataFrame, key: str = "run_key",
                  value: str = "avg_cpu") -> DataFrame:
    """Every key gets its sample mean, else a fallback reading, else 0.0.

    ``keys`` holds every run key and optionally a ``fallback`` reading;
    ``means`` holds ``(key, n_samples, value)`` for keys that have samples.
    """
    return fallback_columns(keys.join(means, key, "left"), key, value)


def fallback_columns(rows: DataFrame, key: str = "run_key", value: str = "avg_cpu") -> DataFrame:
    """J6 on one row per key: ``n_samples``, ``value`` or its fallback, and which it was."""
    cand = [F.col(value)]
    if "fallback" in rows.columns:
        cand.append(F.col("fallback"))
    return rows.select(key,
                       F.coalesce(F.col("n_samples"), F.lit(0)).cast("bigint").alias("n_samples"),
                       F.coalesce(*cand, F.lit(0.0)).alias(value),
                       F.col(value).isNull().alias("used_fallback"))


# ---------------------------------------------------------------- runs
def successful(runs: DataFrame) -> DataFrame:
    """P5: keep runs whose return code is 0."""
    return runs.where(F.col("return_code") == 0)


def with_durations(runs: DataFrame) -> DataFrame:
    """M7 + F8: initialisation, processing and run time as differences of timestamps."""
    return (runs.withColumn("init_s", seconds_between("start_ts", "action_ts"))
                .withColumn("processing_s", seconds_between("action_ts", "end_ts"))
                .withColumn("runtime_s", seconds_between("start_ts", "end_ts")))


FIRST_RUN = ("failure_reschedules", "failed_core_budget", "total_cores")


def first_run(runs: DataFrame, config: tuple[str, ...]) -> DataFrame:
    """A5 + M8: constants of each configuration's first run (smallest time, then run_id).

    One row per (configuration, time) first, then the earliest of those: equal
    times are decided by run_id, and both steps are hash aggregates.
    """
    cols = [c for c in FIRST_RUN if c in runs.columns]
    per_time = (runs.groupBy(*config, "ts")
                    .agg(F.min("run_id").alias("first_run_id"),
                         *[F.min_by(c, "run_id").alias(c) for c in cols]))
    return per_time.groupBy(*config).agg(*[F.min_by(c, "ts").alias(c) for c in ("first_run_id", *cols)])


def config_summary(runs: DataFrame, facts: DataFrame, per_run: DataFrame | None = None,
                   config: tuple[str, ...] = ("dataset", "cores", "variant")) -> DataFrame:
    """M9: per-configuration averages, constants from the first run, throughput.

    ``facts`` carries ``(dataset, word_count, dataset_bytes)``.  Throughput is
    words (or MB) over the mean *processing* time, 0 when that time is 0.
    ``per_run`` carries ``(run_key, avg_cpu, avg_mem_mb)`` (A3); a configuration
    gets the mean over its runs (A4).  A run without a retry adds 0 s (M6).  A null in
    ``config`` is a configuration of its own.
    """
    if per_run is not None:
        runs = runs.join(per_run.select("run_key", "avg_cpu", "avg_mem_mb"), "run_key", "left")
    means = [F.avg(c).alias(c) for c in ("avg_cpu", "avg_mem_mb") if c in runs.columns]
    if "retry_s" in runs.columns:
        means.append(F.avg(F.coalesce(F.col("retry_s"), F.lit(0.0))).alias("avg_retry_s"))
    per_cfg = (runs.groupBy(*config)
                   .agg(F.count(F.lit(1)).alias("n_runs"),
                        F.avg("runtime_s").alias("avg_runtime_s"),
                        F.avg("init_s").alias("avg_init_s"),
                        F.avg("processing_s").alias("avg_processing_s"), *means))
    firsts = first_run(runs, config).withColumnsRenamed({c: f"_{c}" for c in config})
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in config])
    per_cfg = per_cfg.join(firsts, same).drop(*[f"_{c}" for c in config])
    return (per_cfg.join(facts, "dataset", "left")
                   .withColumn("throughput_words",
                               safe_ratio("word_count", "avg_processing_s"))
                   .withColumn("throughput_mb",
                               safe_ratio(F.col("dataset_bytes") / F.lit(MB),
                                          "avg_processing_s")))


def runtime_by_config(runs: DataFrame, variant: str = "baseline") -> DataFrame:
    return (runs.where(F.col("variant") == variant)
                .groupBy("dataset", "cores")
                .agg(F.avg("runtime_s").alias("runtime_s")))


def speedup(per_cfg: DataFrame) -> DataFrame:
    """W1 + M3 + M4: runtime of the first (smallest) core count over this one.

    The window runs over one row per (dataset, cores), partitioned by dataset.
    """
    w = Window.partitionBy("dataset").orderBy("cores")
    return (per_cfg
            .withColumn("baseline_time", F.first("runtime_s").over(w))
            .withColumn("speedup", safe_ratio("baseline_time", "runtime_s"))
            .withColumn("parallel_efficiency", F.col("speedup") / F.col("cores")))


def recovery_overhead(runs: DataFrame) -> DataFrame:
    """J1 + M5: pair each baseline configuration with its failure runs.

    Both variants come from the same table, so the pairing is one grouped pass
    with conditional means (one shuffle, no join); configurations without a
    failure run keep NULL failure columns, as a left outer join would.
    """
    base = F.when(F.col("variant") == "baseline", F.col("runtime_s"))
    fail = F.when(F.col("variant") == "failure", F.col("runtime_s"))
    return (runs.groupBy("dataset", "cores")
                .agg(F.avg(base).alias("baseline_runtime_s"),
                     F.avg(fail).alias("failure_runtime_s"))
                .where(F.col("baseline_runtime_s").isNotNull())
                .withColumn("recovery_overhead_s",
                            F.col("failure_runtime_s") - F.col("baseline_runtime_s")))


def pair_runs(baseline: DataFrame, failure: DataFrame,
              keys: tuple[str, ...] = ("dataset", "cores")) -> DataFrame:
    """J1 for two separately produced result tables: baseline LEFT JOIN failure."""
    b = baseline.select(*keys, F.col("runtime_s").alias("baseline_runtime_s"))
    f = failure.select(*keys, F.col("runtime_s").alias("failure_runtime_s"))
    return (b.join(f, list(keys), "left")
             .withColumn("recovery_overhead_s",
                         F.col("failure_runtime_s") - F.col("baseline_runtime_s")))


def policy_frame(spark: SparkSession, policy: dict[int, int]) -> DataFrame:
    """The failure policy ``cores -> failures`` as a small table."""
    schema = T.StructType([T.StructField("cores", T.IntegerType(), False),
                           T.StructField("failures", T.IntegerType(), False)])
    return spark.createDataFrame([(int(k), int(v)) for k, v in policy.items()], schema)


def policy_grid(runs: DataFrame, policy: DataFrame, cores: list[int],
                positive_only: bool = True) -> DataFrame:
    """J2 + J3 + P12: every dataset at every declared core count, with its failure budget.

    The grid explodes the experiment's core list for each dataset of the run log,
    so pairs that never ran are there, too; a core count without a policy has
    budget 0.
    """
    grid = (runs.select("dataset").distinct()
                .select("dataset", F.explode(F.array(*[F.lit(int(c)) for c in cores])).alias("cores")))
    out = (grid.join(policy, "cores", "left")
               .select("dataset", "cores",
                       F.coalesce(F.col("failures"), F.lit(0)).alias("failures")))
    return out.where(F.col("failures") > 0) if positive_only else out


def outcomes(runs: DataFrame) -> DataFrame:
    """P6 + F10: label failure-test runs ``Recovered`` / ``Failed``."""
    return (runs.where(F.col("variant") == "failure")
                .select("run_id", "dataset", "cores", "runtime_s",
                        F.when(F.col("return_code") == 0, F.lit(OUTCOME_OK))
                         .otherwise(F.lit(OUTCOME_FAILED)).alias("outcome"),
                        F.format_string(FAILURE_LABEL_FORMAT, F.col("dataset"),
                                        F.col("cores")).alias("label")))


def results_union(runs: DataFrame, sort_mb: int = 100) -> DataFrame:
    """The run-results rows and the failure-test rows in one table.

    The two producers have different columns; ``unionByName`` aligns them and
    fills the missing ones with NULL (UNION ALL, no de-duplication).
    """
    main = (successful(runs).where(F.col("variant") == "baseline")
            .select("run_id", "dataset", "cores", F.lit(sort_mb).alias("sort_mb"),
                    F.col("runtime_s").alias("runtime_seconds"),
                    F.format_string(RUN_LABEL_FORMAT, F.col("dataset"), F.col("cores"),
                                    F.lit(sort_mb)).alias("label")))
    ft = outcomes(runs).select("run_id", "dataset", "cores",
                               F.col("runtime_s").alias("runtime_seconds"), "outcome", "label")
    return main.unionByName(ft, allowMissingColumns=True)


# ---------------------------------------------------------------- ordered picks
def first_crossing(samples: DataFrame, threshold: float = 50.0,
                   key: str = "run_key", ts: str = "ts",
                   value: str = "progress") -> DataFrame:
    """W3 + P10: first time each run reaches ``threshold``, latched once.

    Readings of one time are reduced to their largest first, so the result does
    not depend on the order of rows; both steps are hash aggregates with a
    map-side partial step.
    """
    per_time = (samples.where(F.col(value) >= threshold)
                       .groupBy(key, ts).agg(F.max(value).alias("_value")))
    return (per_time.groupBy(key)
                    .agg(F.min(ts).alias("first_ts"),
                         F.min_by("_value", ts).alias("value_at")))


def latest_match(df: DataFrame, key: str, ts: str, text: str, needle: str,
                 pick: str) -> DataFrame:
    """W4 + P7: per key, the most recent row whose ``text`` contains ``needle``.

    Hash aggregates instead of ``row_number`` over a window: no key's rows are
    sorted or gathered in one task.  Of rows with equal times the largest
    ``pick`` counts.
    """
    per_time = (df.where(F.col(text).contains(needle))
                  .groupBy(key, ts).agg(F.max(pick).alias("_pick")))
    return (per_time.groupBy(key)
                    .agg(F.max(ts).alias("last_ts"),
                         F.max_by("_pick", ts).alias(f"last_{pick}")))


def text_lines(df: DataFrame, block: str, line: str = "line") -> DataFrame:
    """one row per line of a text block (``\\n``, ``\\r\\n`` and ``\\r`` end a line)."""
    return df.select(F.explode(F.split(block, "\\r\\n|\\r|\\n")).alias(line))


def distinct_first_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """P8 + S2 + U1: distinct integer first fields, in numeric order."""
    from ..functions.scalar import first_field_int
    return (lines.select(first_field_int(line).alias("core"))
                 .where(F.col("core").isNotNull())
                 .distinct()
                 .orderBy("core"))
