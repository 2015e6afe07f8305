"""The scalability experiment: word count timed at several core counts.

For each core count a fresh ``local[N]`` session (one subprocess each, since
a JVM holds one SparkContext) scans a text dataset and runs the jobs: the
global token count (the Spark program) and optionally the per-word count
written as ``word<TAB>count`` files with one reducer per core (the MapReduce
program);
each run records init time (building the plan) and processing time (the
action).  The run log is then summarised with the engine's own operators -
mean of runs per configuration, throughput over processing time, speedup
against the first core count, parallel efficiency - and written as a result
CSV and a text report.

This is a benchmark harness around the operators, for one machine, not part of
the library: the per-run timings are measured on the driver by definition.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexitally.functions.tokenize import LETTERS, WHITESPACE  # noqa: E402

RESULT_COLUMNS = ["dataset", "cores", "runtime_s", "avg_init_s", "avg_processing_s",
                  "throughput_words", "throughput_mb", "speedup", "parallel_efficiency"]


JOBS = ("count", "wordcount")


def _job(spark, job: str, path: str, rule: str, recursive: bool, cores: int, out: str):
    """Build and run one job; returns (plan built at, finished at, word total)."""
    from pyspark.sql import functions as F

    from lexitally.operators.wordcount import word_freq, word_total
    from lexitally.sinks.files import write_word_counts
    from lexitally.sources.text import read_lines

    if job == "count":              # the Spark program: one global total
        df = word_total(read_lines(spark, path, recursive), "value", rule)
        t1 = time.perf_counter()
        n = df.first()["word_count"]
    else:                           # the MapReduce program: per-word files, reducers = cores
        freq = word_freq(read_lines(spark, path, recursive=True), "value", LETTERS)
        t1 = time.perf_counter()
        write_word_counts(freq, out, None, mode="overwrite")   # one shuffle, `cores` reducers
        t2 = time.perf_counter()
        # its token total, from its own (small) output, outside the timing
        n = (spark.read.text(out)
             .agg(F.sum(F.split("value", "\t").getItem(1).cast("long")).alias("n"))
             .first()["n"])
        return t1, t2, n
    return t1, time.perf_counter(), n


def time_runs(path: str, cores: int, runs: int, rule: str = WHITESPACE,
              recursive: bool = False, jobs: tuple[str, ...] = ("count",)) -> list[dict]:
    """Time ``runs`` of each job over ``path`` in a ``local[cores]`` session."""
    import tempfile

    from lexitally.session import build_session
    from lexitally.sources.text import dataset_bytes

    spark = build_session(f"local[{cores}]", "lexitally-experiment", shuffle_partitions=cores)
    if "wordcount" in jobs:
        from lexitally.sinks.files import reducer_session
        reducer_session(spark, cores)    # reducers = cores, as in the published runs
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .load(path).select("path", "length"))
    size = dataset_bytes(spark, path, by_dataset=False, recursive=recursive).first()["dataset_bytes"]
    first = files.orderBy("path").first()
    out = tempfile.mkdtemp(prefix="lexitally-wordcount-")     # a bench on one machine
    log = []
    for job in jobs:
        if first is not None:       # warm the JVM (JIT, codegen) on one file; not logged
            _job(spark, job, first["path"], rule, False, cores, out + "/warm")
        for i in range(1, runs + 1):
            t0 = time.perf_counter()
            t1, t2, n = _job(spark, job, path, rule, recursive, cores, f"{out}/{job}{i}")
            log.append({"run_id": cores * 1000 + i, "ts": cores * 1000 + i, "cores": cores,
                        "job": job, "init_s": t1 - t0, "processing_s": t2 - t1,
                        "runtime_s": t2 - t0, "word_count": n, "dataset_bytes": size})
    spark.stop()
    shutil.rmtree(out, ignore_errors=True)
    return log


def collect_runs(path: str, cores: list[int], runs: int, rule: str = WHITESPACE,
                 recursive: bool = False, jobs: tuple[str, ...] = ("count",)) -> list[dict]:
    """Run ``time_runs`` once per core count, each in its own process."""
    root = str(Path(__file__).resolve().parents[1])
    env = dict(os.environ, PYTHONPATH=os.pathsep.join(
        p for p in (root, os.environ.get("PYTHONPATH", "")) if p))
    log: list[dict] = []
    for c in cores:
        out = subprocess.run(
            [sys.executable, "-m", "scripts.experiment", path, str(c), str(runs), rule,
             "1" if recursive else "0", ",".join(jobs)],
            capture_output=True, text=True, timeout=3600, check=True, env=env, cwd=root)
        log += [json.loads(line) for line in out.stdout.splitlines() if line.startswith("{")]
    return log


def summarise(spark, log: list[dict], dataset: str):
    """Per-core-count summary with speedup, from a run log (one row per run)."""
    from pyspark.sql import functions as F

    from lexitally.operators import runs as R

    schema = ("run_id long, ts long, cores int, job string, init_s double, processing_s double, "
              "runtime_s double, word_count long, dataset_bytes long")
    runlog = spark.createDataFrame(log, schema)
    # one speedup series per job: the job is part of the dataset label
    label = F.when(F.col("job") == "count", F.lit(dataset)) \
             .otherwise(F.concat(F.lit(dataset), F.lit("/"), F.col("job")))
    runlog = runlog.withColumn("dataset", label).withColumn("variant", F.lit("baseline"))
    facts = runlog.groupBy("dataset").agg(F.min_by("word_count", "ts").alias("word_count"),
                                          F.min_by("dataset_bytes", "ts").alias("dataset_bytes"))
    # the harness takes no resource samples: the report shows 0 for them
    summary = R.config_summary(runlog.drop("word_count", "dataset_bytes"), facts)
    summary = summary.withColumn("avg_cpu", F.lit(None).cast("double")).withColumn(
        "avg_mem_mb", F.lit(None).cast("double"))
    return R.speedup(summary.withColumn("runtime_s", F.col("avg_runtime_s")))


def write_outputs(speedups, results_path: str | None, report_path: str | None,
                  mode: str = "overwrite") -> None:
    """Result CSV (fixed column order) and the text report (blocks + table);
    ``append`` adds to earlier datasets' output instead of replacing it."""
    from pyspark.sql import functions as F

    from lexitally.operators import report
    from lexitally.sinks import files

    if results_path:
        files.write_table_csv(speedups.orderBy("dataset", "cores"), results_path,
                              RESULT_COLUMNS, mode)
    if report_path:
        # per core count: its block, then the scalability table so far
        lines = report.run_block(report.scalability_lines(speedups))
        text = (lines.select("dataset", "cores", F.lit(0).alias("part"), "block")
                .unionByName(lines.select("dataset", "cores", F.lit(1).alias("part"),
                                          F.col("cumulative").alias("block")))
                .orderBy("dataset", "cores", "part"))
        # one row per core count: a single ordered report file
        files.write_report(text.coalesce(1), report_path, mode=mode)


def scaling_run(path: str, cores: list[int], runs: int, dataset: str | None = None,
                   rule: str = WHITESPACE, recursive: bool = False,
                   results_path: str | None = None, report_path: str | None = None,
                   mode: str = "overwrite", jobs: tuple[str, ...] = ("count",)) -> list:
    """Time, summarise and write; returns the summary rows (one per core count)."""
    from pyspark.sql import SparkSession

    from lexitally.session import build_session

    log = collect_runs(path, cores, runs, rule, recursive, jobs)
    active = SparkSession.getActiveSession()      # reuse the caller's session if any
    spark = active or build_session("local[2]", "lexitally-experiment-report",
                                    shuffle_partitions=2)
    sp = summarise(spark, log, dataset or path.rstrip("/").rsplit("/", 1)[-1])
    write_outputs(sp, results_path, report_path, mode)
    rows = sorted(sp.collect(), key=lambda r: (r.dataset, r.cores))  # one per job x cores
    if active is None:
        spark.stop()
    return rows


if __name__ == "__main__":
    _path, _cores, _runs, _rule, _rec, _jobs = sys.argv[1:7]
    for rec in time_runs(_path, int(_cores), int(_runs), _rule, _rec == "1",
                         tuple(_jobs.split(","))):
        print(json.dumps(rec), flush=True)
