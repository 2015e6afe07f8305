"""Run analytics: published numbers as goldens, plus semantics of each step."""

import io
import csv

import pytest
from pyspark.sql import functions as F

from lexitally.functions.scalar import json_number, safe_ratio, seconds_between, signed2
from lexitally.operators import runs as R
from lexitally.operators.report import scalability_lines

# Published MapReduce results (dataset, cores, runtime_seconds,
# total_words, throughput_words_per_sec, baseline_time, speedup, efficiency).
PUBLISHED = """dataset,cores,runtime_seconds,total_words,throughput,baseline_time,speedup,efficiency
small,1,22212.38350224495,327856192,14760.063545943389,22212.38350224495,1.0,1.0
small,2,17519.748833179474,327856192,18713.521245184475,22212.38350224495,1.2678482844559056,0.6339241422279528
small,4,12051.694246530533,327856192,27204.15779668356,22212.38350224495,1.8430921866972767,0.4607730466743192
small,8,9047.342267036438,327856192,36237.8455819593,22212.38350224495,2.455128019548317,0.3068910024435396
toy,1,2292.62476849556,32938985,14367.36855181707,2292.62476849556,1.0,1.0
toy,2,1880.9935314655304,32938985,17511.48233579325,2292.62476849556,1.2188371358775048,0.6094185679387524
toy,4,1236.771462917328,32938985,26633.04093571393,2292.62476849556,1.853717390185943,0.46342934754648574
toy,8,952.7410862445832,32938985,34572.8608491479,2292.62476849556,2.4063460698775914,0.3007932587346989
"""


def _close(a, b, rel=1e-9):
    return abs(a - b) <= rel * max(abs(a), abs(b), 1e-300)


def test_published_speedup_throughput_efficiency(spark):
    rows = list(csv.DictReader(io.StringIO(PUBLISHED)))
    df = spark.createDataFrame(
        [(r["dataset"], int(r["cores"]), float(r["runtime_seconds"]), int(r["total_words"]))
         for r in rows], "dataset string, cores int, runtime_s double, total_words bigint")
    out = R.speedup(df).withColumn("throughput", safe_ratio("total_words", "runtime_s"))
    got = {(r.dataset, r.cores): r for r in out.collect()}
    for r in rows:
        g = got[(r["dataset"], int(r["cores"]))]
        assert _close(g.baseline_time, float(r["baseline_time"]))
        assert _close(g.speedup, float(r["speedup"]))
        assert _close(g.parallel_efficiency, float(r["efficiency"]))
        assert _close(g.throughput, float(r["throughput"]))


def test_safe_ratio_zero_and_format(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.14159, 1.0), (-2.0, 1.0)], "n double, d double")
    got = df.select(safe_ratio("n", "d").alias("r"), signed2(safe_ratio("n", "d")).alias("s")).collect()
    assert [r.r for r in got] == [0.0, 3.14159, -2.0]
    assert [r.s for r in got] == [" 0.00", " 3.14", "-2.00"]


def test_format_rounds_like_python(spark):
    vals = [81.975, 0.125, 2.675, 1.005, -0.005, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(signed2("x").alias("s")).collect()]
    assert got == [None if v is None else f"{v: .2f}" for v in vals]


def test_mean_of_means_is_not_pooled(spark):
    samples = spark.createDataFrame(
        [(1, 1, 10.0, 0.0), (1, 2, 20.0, 0.0), (1, 3, 30.0, 0.0), (2, 1, 100.0, 1048576.0)],
        "run_key long, ts long, cpu double, mem_bytes double")
    per_run = R.run_means(R.tick_totals(samples)).withColumn("cfg", F.lit(1))
    row = R.mean_of_means(per_run, ["cfg"], ["avg_cpu", "avg_mem_mb"]).first()
    assert row.avg_cpu == pytest.approx((20.0 + 100.0) / 2)
    assert row.avg_mem_mb == pytest.approx(0.5)


def test_ticks_sum_processes(spark):
    samples = spark.createDataFrame(
        [(1, 5, 10.0, 1.0), (1, 5, 20.0, 2.0), (1, 6, 1.0, 1.0)],
        "run_key long, ts long, cpu double, mem_bytes double")
    got = {r.ts: (r.cpu, r.mem_bytes, r.n_procs) for r in R.tick_totals(samples).collect()}
    assert got == {5: (30.0, 3.0, 2), 6: (1.0, 1.0, 1)}


def test_fallback_chain(spark):
    keys = spark.createDataFrame([(1, 7.0), (2, 8.0), (3, None)], "run_key long, fallback double")
    means = spark.createDataFrame([(1, 4, 2.5)], "run_key long, n_samples long, avg_cpu double")
    got = {r.run_key: (r.n_samples, r.avg_cpu, r.used_fallback)
           for r in R.with_fallback(keys, means).collect()}
    assert got == {1: (4, 2.5, False), 2: (0, 8.0, True), 3: (0, 0.0, True)}


def test_policy_default_zero_and_positive_filter(spark):
    runs = spark.createDataFrame([("en", 1), ("en", 2), ("fr", 8), ("fr", 8)],
                                 "dataset string, cores int")
    pol = R.policy_frame(spark, {1: 1, 8: 0})
    allrows = {(r.dataset, r.cores): r.failures
               for r in R.policy_grid(runs, pol, [1, 2, 8], positive_only=False).collect()}
    # every declared core count, also those that a dataset never ran on
    assert allrows == {("en", 1): 1, ("en", 2): 0, ("en", 8): 0, ("fr", 1): 1, ("fr", 2): 0, ("fr", 8): 0}
    assert sorted((r.dataset, r.cores) for r in R.policy_grid(runs, pol, [1, 2, 8]).collect()) == [("en", 1), ("fr", 1)]


def test_pair_runs_left_outer(spark):
    base = spark.createDataFrame([("toy", 1, 10.0), ("toy", 2, 6.0)],
                                 "dataset string, cores int, runtime_s double")
    fail = spark.createDataFrame([("toy", 1, 12.5)], "dataset string, cores int, runtime_s double")
    got = {r.cores: r.recovery_overhead_s for r in R.pair_runs(base, fail).collect()}
    assert got == {1: 2.5, 2: None}


def test_first_crossing_latched(spark):
    s = spark.createDataFrame([(1, 1, 10.0), (1, 2, 55.0), (1, 3, 80.0), (2, 1, 49.9)],
                              "run_key long, ts long, progress double")
    got = [(r.run_key, r.first_ts, r.value_at) for r in R.first_crossing(s).collect()]
    assert got == [(1, 2, 55.0)]


def test_latest_match(spark):
    df = spark.createDataFrame([(1, 1, "YarnChild", 11), (1, 3, "YarnChild", 13),
                                (1, 4, "Other", 14)], "k long, ts long, name string, pid long")
    r = R.latest_match(df, "k", "ts", "name", "YarnChild", "pid").first()
    assert (r.last_ts, r.last_pid) == (3, 13)


def test_json_default(spark):
    df = spark.createDataFrame(
        [('{"apps": {"app": [{"progress": 62.5}]}}',), ('{"apps": null}',), ("not json",), (None,)],
        "j string")
    got = [r.p for r in df.select(json_number("j", "$.apps.app[0].progress").alias("p")).collect()]
    assert got == [62.5, 0.0, 0.0, 0.0]


def test_first_fields(spark):
    block = spark.createDataFrame([("3 Container\n  1 x\r\n3 y\rabc z\n\t7 tab",), (None,)], "block string")
    lines = R.text_lines(block, "block")
    assert lines.count() == 5
    assert [r.core for r in R.distinct_first_fields(lines).collect()] == [1, 3, 7]
    named = lines.where(F.col("line").contains("Cont"))
    assert [r.core for r in R.distinct_first_fields(named).collect()] == [3]


def test_cumulative_lines(spark):
    sp = spark.createDataFrame([("toy", 1, 1.0), ("toy", 2, 1.5), ("toy", 4, 2.25)],
                               "dataset string, cores int, speedup double")
    rows = sorted(scalability_lines(sp).collect(), key=lambda r: r.cores)
    assert rows[0].line == "1 cores:  1.00x"
    assert rows[2].cumulative.splitlines()[1:] == ["1 cores:  1.00x", "2 cores:  1.50x",
                                                  "4 cores:  2.25x"]


def test_summary_retry_and_first_run_constants(spark):
    runs = spark.createDataFrame(
        [(1, 10, "toy", 2, "failure", 1.0, 4.0, 5.0, 2.0, 1, 1),
         (2, 20, "toy", 2, "failure", 1.0, 6.0, 7.0, None, 3, 1)],
        "run_id long, ts long, dataset string, cores int, variant string, init_s double, "
        "processing_s double, runtime_s double, retry_s double, failure_reschedules int, "
        "failed_core_budget int")
    facts = spark.createDataFrame([("toy", 100, 1048576)],
                                  "dataset string, word_count long, dataset_bytes long")
    r = R.config_summary(runs, facts).first()
    assert (r.n_runs, r.avg_retry_s, r.failure_reschedules, r.first_run_id) == (2, 1.0, 1, 1)
    assert r.throughput_words == pytest.approx(100 / 5.0)
    assert r.throughput_mb == pytest.approx(1 / 5.0)


def test_seconds_between(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS a, "
                   "TIMESTAMP_NTZ'2024-01-01 00:01:01.5' AS b")
    assert df.select(seconds_between("a", "b").alias("d")).first().d == 61.5


def test_rounding_matches_scaled_binary_rule(spark):
    import math

    from pyspark.sql import functions as F

    from lexitally.functions.scalar import rounded
    vals = [2.675, -2.675, 1.005, 0.125, 1391.13 / 32, 1234.5678915, None]

    def c_round(x, p):         # C's round(x * 10^p) / 10^p: half away from zero
        m = 10.0 ** p
        v = x * m
        return math.copysign(math.floor(abs(v) + 0.5), v) / m

    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for p in (2, 6):
        got = [r.r for r in df.select(rounded("x", p).alias("r")).collect()]
        assert got == [None if v is None else c_round(v, p) for v in vals], p
    # where the rules part: 1.005 * 100 is 100.49999... in binary, so scaled
    # rounding gives 1.0, while Spark's round works on the decimal form
    # "1.005" and gives 1.01; likewise 33.4634375 at 6 places
    ties = spark.createDataFrame([(1.005, 33.4634375)], "a double, b double").select(
        rounded("a", 2).alias("a2"), F.round("a", 2).alias("a2s"),
        rounded("b", 6).alias("b6"), F.round("b", 6).alias("b6s")).first()
    assert (ties.a2, ties.a2s, ties.b6, ties.b6s) == (1.0, 1.01, 33.463437, 33.463438)


def test_ties_do_not_depend_on_row_order(spark):
    rows = [(1, 5, 90.0, "xa", 3), (1, 5, 50.0, "xb", 9), (1, 7, 99.0, "y", 1), (2, 1, 60.0, "x", 4)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "run_key long, ts long, progress double, name string, pid long").coalesce(1)
        got = {r.run_key: (r.first_ts, r.value_at) for r in R.first_crossing(df).collect()}
        assert got == {1: (5, 90.0), 2: (1, 60.0)}
        last = {r.run_key: (r.last_ts, r.last_pid) for r in R.latest_match(df, "run_key", "ts", "name", "x", "pid").collect()}
        assert last == {1: (5, 9), 2: (1, 4)}


def test_durations_are_differences(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS start_ts, TIMESTAMP'2024-01-01 00:00:02.5' AS action_ts, "
                   "TIMESTAMP'2024-01-01 00:01:00' AS end_ts")
    r = R.with_durations(df).first()
    assert (r.init_s, r.processing_s, r.runtime_s) == (2.5, 57.5, 60.0)


def test_failure_block_shows_the_runs_reschedules(spark):
    from lexitally.operators.report import failure_block
    row = (4, 5, 10.0, 1.0, 50.0, 512.0, 12.5, 100.0, 2.0, 0.25, 3, 2.5)
    cols = ("cores int, failures int, baseline_runtime_s double, f_avg_init_s double, f_avg_cpu double, "
            "f_avg_mem_mb double, f_avg_runtime_s double, f_throughput_words double, f_throughput_mb double, "
            "f_avg_retry_s double, f_failure_reschedules int, recovery_overhead_s double")
    lines = failure_block(spark.createDataFrame([row], cols)).first().block.split("\n")
    assert lines[1] == "4 Cores with 5 core failure(s):"
    assert lines[-2] == "Measured Retry Overhead (time spent reprocessing):  0.25 seconds"
    assert lines[-1] == "Rescheduled partitions (proxy for failed cores): 3"
    none = failure_block(spark.createDataFrame([row[:10] + (0, 2.5)], cols)).first().block
    assert "Rescheduled" not in none
