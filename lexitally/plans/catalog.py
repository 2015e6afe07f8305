"""The registered queries: Spark builders and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables.  Most are lazy; those that exercise a sink (``q_file_*``, ``q_results_*``,
``q_metrics_series``, ``q_ingest_*``, ``q_write_modes``, ``q_report_file``) write
derived files below the shared folder while they are built, and read them back.  Doubles are rounded to 6 places on both sides so that
different summation orders compare equal; counts are BIGINT on both sides
(DuckDB's ``sum(bigint)`` is HUGEINT, hence the casts in the SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch_micros, json_number, rounded
from ..functions.tokenize import LETTERS, WHITESPACE, register_sql
from ..operators import attach, report, runs as R, sampling, wordcount as W
from ..session import scratch_path
from ..sinks import files as sinks
from ..sources import text as textsrc
from ..sources.results import BAD, read_results
from ..sources.tables import read_table, split_session
from . import fixtures as FX
from .fixtures import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_K, SAMPLE_SEED = 8, "42"
CROSSING_THRESHOLD = 50.0
LATEST_NEEDLE = "error"
PURCHASE = "purchase"
PROCESS_NEEDLE = "ck"
# Failure budget per core count for the policy grid (8 cores unlisted -> 0).
FAILURE_POLICY = {1: 1, 2: 1, 4: 1}
CORE_COUNTS = [1, 2, 4, 8]
PROFILE_BUCKETS = 16
SPLIT_BYTES = 1 << 20


def _round(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.select(*[rounded(c, places).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _docs(spark, d, *cols):
    return read_table(spark, d, "documents", list(cols) or ["text"])


def _events(spark, d, *cols):
    return read_table(spark, d, "events", list(cols) if cols else None)


def _runs(spark, d):
    return R.with_durations(FX.runs(_events(spark, d, "event_id", "ts", "user_id", "event_type", "value")))


def _samples(spark, d):
    return FX.samples(_events(spark, d, "event_id", "ts", "user_id", "event_type", "value"))


def _triggers(spark, d):
    return FX.triggers(_events(spark, d, "event_id", "ts", "user_id", "event_type"))


# ------------------------------------------------------------------ text
def q_ws_word_total(spark, d):
    """A1 + G1 + P1 + P2: whitespace-rule token total of all documents."""
    return W.word_total(_docs(spark, d), "text", WHITESPACE)


def q_alpha_word_freq(spark, d):
    """A2 + G2 (flagship): letter-rule count per word."""
    return W.word_freq(_docs(spark, d), "text", LETTERS)


def q_ws_word_freq(spark, d):
    """A2 + G1: whitespace-rule count per word."""
    return W.word_freq(_docs(spark, d), "text", WHITESPACE)


def q_dataset_words(spark, d):
    """Letter-rule words per dataset (language)."""
    return W.dataset_words(_docs(spark, d, "lang", "text"), "lang", "text", LETTERS)


def q_dataset_size(spark, d):
    """Rows and UTF-8 bytes per dataset."""
    return W.dataset_bytes(_docs(spark, d, "lang", "text"), "lang", "text")


def q_sorted_kv_lines(spark, d):
    """S1 + IO7: ``word<TAB>count`` lines in hash-partitioned, sorted reducer files."""
    freq = W.word_freq(_docs(spark, d), "text", LETTERS)
    return W.kv_lines(W.reducer_sorted(freq))


def q_partition_profile(spark, d):
    """S6 + X3: rows per key bucket (a skew profile of the layout by doc_id)."""
    return sampling.bucket_profile(_docs(spark, d, "doc_id"), "doc_id", PROFILE_BUCKETS)


def q_split_word_total(spark, d):
    """The global count with the scan cut into splits of 1 MB; any split gives the same total."""
    return W.word_total(_docs(split_session(spark, SPLIT_BYTES), d, "text"), "text", WHITESPACE)


def q_missing_datasets(spark, d):
    """J7 + IO5: documents not yet in the target (labels), by left anti join."""
    docs = _docs(spark, d, "doc_id", "lang")
    have = read_table(spark, d, "labels", ["doc_id"])
    return (docs.join(have, "doc_id", "left_anti")
                .select("doc_id", F.col("lang").alias("dataset")))


def _unhive(c):
    """``lang=en`` (a partition folder name) -> ``en``."""
    return F.regexp_replace(c, r"^[^=/]+=", "")


def q_file_dataset_words(spark, d):
    """IO1-IO4 + IO7: documents written as one text folder per dataset, then
    scanned recursively, tagged by folder, counted (letter rule) and sized
    from the file listing."""
    root = scratch_path(spark, "datasets")
    (_docs(spark, d, "lang", "text")
        .select("lang", F.col("text").alias("value"))
        .write.partitionBy("lang").text(root))
    lines = textsrc.read_datasets(spark, root).withColumn("dataset", _unhive("dataset"))
    words = W.dataset_words(lines, "dataset", "value", LETTERS)
    sizes = textsrc.dataset_bytes(spark, root).withColumn("dataset", _unhive("dataset"))
    return words.join(sizes, "dataset")


def q_lines_one_level(spark, d):
    """IO1 + IO4 (one level): the lines of a folder's own files, not of folders below it."""
    root = scratch_path(spark, "one level")
    docs = _docs(spark, d, "lang", "text").select("lang", F.col("text").alias("value"))
    docs.where("lang = 'en'").select("value").write.text(root)
    docs.where("lang <> 'en'").select("value").write.text(root + "/below")
    lines = textsrc.read_lines(spark, root)
    size = textsrc.dataset_bytes(spark, root, by_dataset=False, recursive=False)
    total = lines.agg(F.count(F.lit(1)).alias("n_lines"),
                      F.sum(F.octet_length("value") + 1).cast("bigint").alias("line_bytes"))
    # both totals side by side: they differ where lines end in \r\n
    return total.unionByName(size, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("n_lines", "line_bytes", "dataset_bytes")])


def _loaded(spark, target):
    back = spark.read.schema("doc_id bigint, load int, dataset string").parquet(target)
    return back.groupBy("dataset", "load").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("id_sum"))


def _load(spark, d, number):
    return _docs(spark, d, "doc_id", "lang").select("doc_id", F.lit(number).alias("load"), F.col("lang").alias("dataset"))


def q_ingest_datasets(spark, d):
    """IO5 + IO6: one dataset put into the target unconditionally (load 1), then all of them
    (load 2), of which the one that is there is skipped."""
    target = scratch_path(spark, "ingest")
    sinks.ingest(_load(spark, d, 1).where("dataset = 'en'"), target)
    sinks.ingest_missing(_load(spark, d, 2), target)
    return _loaded(spark, target)


def q_replace_dataset(spark, d):
    """IO5 + IO6 + IO8: all datasets loaded (load 1), of which a broken-off load left 'fr' only its
    short documents; 'fr' is then replaced whole (load 2) and the others keep their files."""
    target = scratch_path(spark, "replaced")
    short = F.length("text") < 1000
    first = (_docs(spark, d, "doc_id", "lang", "text").where((F.col("lang") != "fr") | short)
             .select("doc_id", F.lit(1).alias("load"), F.col("lang").alias("dataset")))
    sinks.ingest(first, target)

    def files(name):
        # metadata alone: one row a file
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.parquet").load(target)
        return listed.select(textsrc.dataset_of(F.col("path"), target, encoded=False).alias("folder"),
                             F.col("path").alias("file"), F.lit(True).alias(name))

    before = scratch_path(spark, "listing")
    files("before").write.parquet(before)
    sinks.replace_datasets(_load(spark, d, 2).where("dataset = 'fr'"), target)
    kept = (spark.read.parquet(before).join(files("after"), ["folder", "file"], "full")
            .groupBy(_unhive("folder").alias("dataset"))
            .agg(F.every(F.col("before").isNotNull() & F.col("after").isNotNull()).alias("files_kept")))
    return _loaded(spark, target).join(kept, "dataset")


def q_write_modes(spark, d):
    """IO7 + IO8 + IO9: word counts written, refused where a result exists, then overwritten."""
    counted, out = scratch_path(spark, "counted"), scratch_path(spark, "counts")
    W.word_freq(_docs(spark, d, "text"), "text", LETTERS).write.parquet(counted)
    freq = spark.read.parquet(counted)
    sinks.write_word_counts(freq.where("n > 5"), out, None)
    try:
        sinks.write_word_counts(freq, out, None)
        refused = False
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        refused = True
    sinks.write_word_counts(freq, out, None, mode="overwrite")
    return spark.read.text(out).select(F.col("value").alias("line"), F.lit(refused).alias("refused"))


def q_job_facts(spark, d):
    """A9 + M1 + M2: rows, words and bytes observed by the pass that writes the word-count files,
    beside what the files hold."""
    out, facts = scratch_path(spark, "observed"), Observation()
    lines = W.observed(_docs(spark, d, "text"), facts, "text", LETTERS)
    sinks.write_word_counts(W.word_freq(lines, "text", LETTERS), out, None)
    seen = facts.get
    count = F.split("value", "\t")[1].cast("bigint")
    return spark.read.text(out).agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("file_words"), F.count(F.lit(1)).alias("n_keys"),
        *[F.first(F.lit(seen[c])).cast("bigint").alias(c) for c in ("n_rows", "n_words", "n_bytes")])


def q_sql_words(spark, d):
    """X1 + X2: both tokenisers as SQL functions, counted per rule and word."""
    own = spark.newSession()
    register_sql(own)
    _docs(own, d, "text").createOrReplaceTempView("docs")
    return own.sql("""
        SELECT 'letters' AS rule, word, count(*) AS n FROM (SELECT letters(text) AS words FROM docs) LATERAL VIEW explode(words) AS word GROUP BY word
        UNION ALL
        SELECT 'whitespace' AS rule, word, count(*) AS n FROM (SELECT whitespace_words(text) AS words FROM docs) LATERAL VIEW explode(words) AS word GROUP BY word""")


def q_partition_index(spark, d):
    """X3 + S6: a function that is given its partition's index, over documents in equal ranges of doc_id."""
    docs = sampling.key_ranges(_docs(spark, d, "doc_id", "text"), "doc_id", PROFILE_BUCKETS)
    return sampling.profile_with_index(docs, "doc_id", "text")


HOST_MB = 16384.0     # memory of the host that the result files' percentages refer to
RESULT_COLUMNS = ["dataset", "cores", "sort_mb", "runtime_seconds", "avg_cpu", "avg_mem"]


def _result_rows(spark, d):
    """Successful runs as result rows: the run's time and its samples' means."""
    per_run = R.run_means(R.tick_totals(_samples(spark, d)))
    return (R.successful(_runs(spark, d)).join(per_run, "run_key", "left")
             .select("variant", "dataset", "cores", F.lit(100).alias("sort_mb"),
                     F.col("runtime_s").alias("runtime_seconds"), "avg_cpu", "avg_mem_mb",
                     (F.col("avg_mem_mb") * 100.0 / F.lit(HOST_MB)).alias("avg_mem")))


def q_results_csv_roundtrip(spark, d):
    """IO10 + P9: result rows written as CSV in the six fixed columns, read back."""
    out = scratch_path(spark, "results")
    sinks.write_table_csv(_result_rows(spark, d), out, RESULT_COLUMNS)
    back = read_results(spark, out).drop(BAD)
    return _round(back, "runtime_seconds", "avg_cpu", "avg_mem_percent")


def q_results_append(spark, d):
    """IO11: baseline results, then failure results added to the same folder."""
    out = scratch_path(spark, "appended")
    rows = _result_rows(spark, d)
    for variant in ("baseline", "failure"):
        sinks.write_table_csv(rows.where(F.col("variant") == variant), out, RESULT_COLUMNS, mode="append")
    back = read_results(spark, out)
    return _round(back.groupBy("dataset", "cores").agg(F.count(F.lit(1)).alias("n_rows"),
                                                       F.avg("runtime_seconds").alias("runtime")), "runtime")


# Header spellings of the published result files.
MAIN_HEADER = {"Dataset": "dataset", "Cores": "cores", "runtime": "runtime_seconds", "cpu usage": "avg_cpu",
               "memory usage": "avg_mem_mb"}
FAILURE_HEADER = {"Data set": "dataset", "cores": "cores", "runtime": "runtime_seconds"}


def q_results_mixed(spark, d):
    """IO14: files of three header spellings in one folder, read under one set of names."""
    out = scratch_path(spark, "mixed results")
    rows = _result_rows(spark, d)
    sinks.write_table_csv(rows.where("dataset = 'en'"), out, RESULT_COLUMNS, mode="append")
    for dataset, header in (("fr", MAIN_HEADER), ("de", FAILURE_HEADER), ("es", MAIN_HEADER)):
        sinks.write_table_csv(rows.where(F.col("dataset") == dataset)
                              .select(*[F.col(c).alias(k) for k, c in header.items()]),
                              out, list(header), mode="append")
    back = read_results(spark, out)
    return _round(back.select("dataset", "cores", "sort_mb", "runtime_seconds", "avg_cpu", "avg_mem_percent",
                              "avg_mem_mb", BAD), "runtime_seconds", "avg_cpu", "avg_mem_percent", "avg_mem_mb")


# ------------------------------------------------------------------ runs
def q_samples_avg(spark, d):
    """A6 -> A3 -> A4 + F6: ticks, per-run means, mean of means per core count."""
    per_run = R.run_means(R.tick_totals(_samples(spark, d)))
    per_run = per_run.withColumn("cores", FX.cores_of(F.col("run_key")))
    out = R.mean_of_means(per_run, ["cores"], ["avg_cpu", "avg_mem_mb"])
    return _round(out, "avg_cpu", "avg_mem_mb")


def _facts(spark, d):
    return W.dataset_facts(_docs(spark, d, "lang", "text"), "lang", "text", WHITESPACE)


def _summary(spark, d):
    per_run = R.run_means(R.tick_totals(_samples(spark, d)))
    return R.config_summary(R.successful(_runs(spark, d)), _facts(spark, d), per_run)


SUMMARY_DOUBLES = ("avg_cpu", "avg_mem_mb", "avg_runtime_s", "avg_init_s", "avg_processing_s", "avg_retry_s",
                   "throughput_words", "throughput_mb")


def q_run_summary(spark, d):
    """M9 + M6 + M7 + M8: all columns of the per-configuration summary."""
    return _round(_summary(spark, d), *SUMMARY_DOUBLES)


def q_speedup(spark, d):
    """W1 + M3 + M4: speedup and parallel efficiency per (dataset, cores)."""
    per_cfg = R.runtime_by_config(R.successful(_runs(spark, d)))
    return _round(R.speedup(per_cfg), "runtime_s", "baseline_time", "speedup",
                  "parallel_efficiency")


def q_recovery_overhead(spark, d):
    """J1 + M5: baseline vs failure runtime per configuration."""
    out = R.recovery_overhead(R.successful(_runs(spark, d)))
    return _round(out, "baseline_runtime_s", "failure_runtime_s", "recovery_overhead_s")


def q_policy_grid(spark, d):
    """J2 + J3 + P12: every dataset at every core count with a positive failure budget."""
    return R.policy_grid(_runs(spark, d), R.policy_frame(spark, FAILURE_POLICY), CORE_COUNTS)


def q_outcomes(spark, d):
    """P6 + F10 + S3: failure-test outcomes with run labels, in order."""
    return _round(R.outcomes(_runs(spark, d)).orderBy("dataset", "cores", "run_id"),
                  "runtime_s")


def q_union_results(spark, d):
    """Run results and failure-test results in one table."""
    return _round(R.results_union(_runs(spark, d)), "runtime_seconds")


def q_first_crossing(spark, d):
    """W3 + P10: first sample at or above 50 % progress per run."""
    out = R.first_crossing(_samples(spark, d), CROSSING_THRESHOLD)
    return out.select("run_key", epoch_micros("first_ts").alias("first_ts_us"),
                      F.col("value_at").alias("progress_at"))


def q_latest_match(spark, d):
    """W4 + P7: latest event whose type contains the needle, per user."""
    ev = _events(spark, d, "event_id", "ts", "user_id", "event_type")
    out = R.latest_match(ev, "user_id", "ts", "event_type", LATEST_NEEDLE, "event_id")
    return out.select("user_id", epoch_micros("last_ts").alias("last_ts_us"),
                      "last_event_id")


def q_attach_events(spark, d):
    """J5 + W5 + A6: each pending event attached to the next tick (FIFO)."""
    ticks = R.tick_totals(_samples(spark, d))
    out = attach.attach_events(ticks, _triggers(spark, d))
    return _round(out.select("run_key", epoch_micros("ts").alias("ts_us"), "n_procs",
                             "cpu", "mem_bytes", "event"), "cpu", "mem_bytes")


SERIES_SCHEMA = ("run_key bigint, ts_us bigint, cpu double, memory double, disk_read bigint, "
                 "disk_write bigint, event string, dataset string, cores int")


def q_metrics_series(spark, d):
    """IO12 + J5: per-tick metrics with their attached event, written as one CSV time
    series per (dataset, cores) (NULL event -> empty cell) and read back."""
    ticks = R.tick_totals(_samples(spark, d)).drop("n_procs")
    dataset = F.concat(F.lit("ds"), F.pmod(F.col("run_key"), F.lit(3)).cast("string"))
    series = (attach.attach_events(ticks, _triggers(spark, d))
              .select(dataset.alias("dataset"), FX.cores_of(F.col("run_key")).alias("cores"), "run_key",
                      epoch_micros("ts").alias("ts_us"), "cpu", F.col("mem_bytes").alias("memory"),
                      "disk_read", "disk_write", "event"))
    out = scratch_path(spark, "series")
    sinks.write_series(series, out)
    back = (spark.read.schema(SERIES_SCHEMA).option("header", "true")
                 .option("nullValue", "").csv(out))
    return _round(back, "cpu", "memory")


def _report_rows(spark, d):
    summary = _summary(spark, d).where(F.col("variant") == "baseline")
    return R.speedup(summary.withColumn("runtime_s", F.col("avg_runtime_s")))


def q_cumulative_report(spark, d):
    """W2 + F9 + M10: scalability lines, cumulative table, report block."""
    out = report.run_block(report.scalability_lines(_report_rows(spark, d)))
    return out.select("dataset", "cores", "line", "cumulative", "block")


def _failure_rows(spark, d):
    return (report.pair_summaries(_summary(spark, d))
            .join(R.policy_frame(spark, FAILURE_POLICY), "cores", "left")
            .withColumn("failures", F.coalesce("failures", F.lit(0)))
            .where(F.col("failures") > 0))


def q_failure_report(spark, d):
    """J1 + J2 + M5 + M6 + M8 + P11 + P12 + F9: failure section of the report."""
    return (report.failure_block(_failure_rows(spark, d))
                  .select("dataset", "cores", "failures", "block"))


def q_report_file(spark, d):
    """IO13: the report file, begun anew and then added to; its lines read back with their counts."""
    out = scratch_path(spark, "report")
    sinks.write_report(report.failure_block(_failure_rows(spark, d)), out)
    sinks.write_report(report.run_block(_report_rows(spark, d)), out)
    sinks.write_report(report.failure_block(_failure_rows(spark, d)), out, mode="append")
    return spark.read.text(out).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def q_samples_fallback(spark, d):
    """Sample mean per run, else the latest reading, else 0 (one grouped pass)."""
    ev = _events(spark, d, "event_id", "ts", "user_id", "event_type", "value")
    sample = F.when(F.col("event_type") == PURCHASE, F.col("value"))
    # readings of one time are reduced to the largest before the latest is taken
    per_time = ev.groupBy(F.col("user_id").alias("run_key"), "ts").agg(
        F.max("value").alias("v"), F.count(sample).alias("n"), F.sum(sample).alias("s"))
    keys = per_time.groupBy("run_key").agg(F.max_by("v", "ts").alias("fallback"),
                                           F.sum("n").alias("n_samples"),
                                           (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_cpu"))
    return _round(R.fallback_columns(keys, "run_key", "avg_cpu"), "avg_cpu")


def q_json_default(spark, d):
    """IO15 + F11 + F12: JSON number with default 0.0."""
    ev = _events(spark, d, "event_id", "props")
    return ev.select("event_id", json_number("props", "$.k").alias("k"))


def q_distinct_first_field(spark, d):
    """F14 + P7 + P8 + S2 + U1: a process listing split into lines, those of the named
    process, their first fields as integers, distinct and sorted."""
    ev = _events(spark, d, "user_id", "event_type")
    lines = R.text_lines(FX.process_listings(ev), "listing")
    return R.distinct_first_fields(lines.where(F.col("line").contains(PROCESS_NEEDLE)))


def q_sample_k(spark, d):
    """S4 + F7: repeatable k-of-n sample (md5 order)."""
    return sampling.sample_k(_events(spark, d, "event_id"), "event_id", SAMPLE_K, SAMPLE_SEED)


QUERIES: dict[str, Query] = {
    "q_ws_word_total": q_ws_word_total,
    "q_alpha_word_freq": q_alpha_word_freq,
    "q_ws_word_freq": q_ws_word_freq,
    "q_dataset_words": q_dataset_words,
    "q_dataset_size": q_dataset_size,
    "q_sorted_kv_lines": q_sorted_kv_lines,
    "q_samples_avg": q_samples_avg,
    "q_run_summary": q_run_summary,
    "q_speedup": q_speedup,
    "q_recovery_overhead": q_recovery_overhead,
    "q_policy_grid": q_policy_grid,
    "q_outcomes": q_outcomes,
    "q_first_crossing": q_first_crossing,
    "q_latest_match": q_latest_match,
    "q_attach_events": q_attach_events,
    "q_metrics_series": q_metrics_series,
    "q_cumulative_report": q_cumulative_report,
    "q_failure_report": q_failure_report,
    "q_samples_fallback": q_samples_fallback,
    "q_json_default": q_json_default,
    "q_distinct_first_field": q_distinct_first_field,
    "q_sample_k": q_sample_k,
    "q_union_results": q_union_results,
    "q_missing_datasets": q_missing_datasets,
    "q_partition_profile": q_partition_profile,
    "q_file_dataset_words": q_file_dataset_words,
    "q_results_csv_roundtrip": q_results_csv_roundtrip,
    "q_split_word_total": q_split_word_total,
    "q_lines_one_level": q_lines_one_level,
    "q_ingest_datasets": q_ingest_datasets,
    "q_write_modes": q_write_modes,
    "q_results_append": q_results_append,
    "q_results_mixed": q_results_mixed,
    "q_report_file": q_report_file,
    "q_replace_dataset": q_replace_dataset,
    "q_job_facts": q_job_facts,
    "q_sql_words": q_sql_words,
    "q_partition_index": q_partition_index,
}


# ------------------------------------------------------------------ oracle SQL
_WS_TOKENS = r"unnest(regexp_split_to_array(coalesce(text, ''), '\s+'))"
_AZ_TOKENS = r"unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]'))"
_WS_COUNT = (r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), "
             r"lambda x: x <> ''))")
_ALPHA_FREQ = f"""
SELECT word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {_AZ_TOKENS} AS word FROM documents) t
WHERE word <> '' GROUP BY word"""
_FACTS = f"""
facts AS (SELECT lang AS dataset, CAST(sum({_WS_COUNT}) AS BIGINT) AS word_count,
                 CAST(sum(octet_length(encode(text))) AS BIGINT) AS dataset_bytes
          FROM documents GROUP BY lang)"""
_PER_RUN = """
ticks AS (SELECT run_key, ts, sum(cpu) AS cpu, sum(mem_bytes) AS mem_bytes, count(*) AS n_procs,
                 max(disk_read) AS disk_read, max(disk_write) AS disk_write
          FROM samples GROUP BY run_key, ts),
per_run AS (SELECT run_key, avg(cpu) AS avg_cpu, avg(mem_bytes) / CAST(1048576 AS DOUBLE) AS avg_mem_mb
            FROM ticks GROUP BY run_key)"""
_CFG = _PER_RUN + """,
ok AS (SELECT runs.*, avg_cpu, avg_mem_mb FROM runs LEFT JOIN per_run USING (run_key) WHERE return_code = 0),
one AS (SELECT *, row_number() OVER (PARTITION BY dataset, cores, variant ORDER BY ts, run_id) AS rn FROM ok),
cfg AS (SELECT dataset, cores, variant, CAST(count(*) AS BIGINT) AS n_runs,
               avg(runtime_s) AS avg_runtime_s, avg(init_s) AS avg_init_s,
               avg(processing_s) AS avg_processing_s, avg(avg_cpu) AS avg_cpu, avg(avg_mem_mb) AS avg_mem_mb,
               avg(coalesce(retry_s, 0.0)) AS avg_retry_s
        FROM ok GROUP BY dataset, cores, variant),
summary AS (SELECT cfg.*, one.run_id AS first_run_id, one.failure_reschedules, one.failed_core_budget,
                   one.cores AS total_cores, facts.word_count, facts.dataset_bytes,
                   CASE WHEN avg_processing_s = 0 THEN 0.0
                        ELSE CAST(word_count AS DOUBLE) / avg_processing_s END AS throughput_words,
                   CASE WHEN avg_processing_s = 0 THEN 0.0
                        ELSE CAST(dataset_bytes AS DOUBLE) / 1048576.0 / avg_processing_s END AS throughput_mb
            FROM cfg JOIN one ON one.rn = 1 AND one.dataset = cfg.dataset AND one.cores = cfg.cores
                                 AND one.variant = cfg.variant
                 LEFT JOIN facts ON cfg.dataset = facts.dataset)"""
_SPEEDUP_OF = """
CASE WHEN runtime_s = 0 THEN 0.0 ELSE baseline_time / runtime_s END"""

# J5 as a replay of the queue: the ticks of a run in order, the events popped one a tick
_ATTACH_CTES = """
, """ + _PER_RUN + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY ts) AS rk FROM ticks),
queue AS (SELECT run_key, list(event ORDER BY ts, event) AS q, list(ts ORDER BY ts, event) AS at
          FROM triggers GROUP BY run_key),
replay AS (
  SELECT r.run_key, r.rk, r.ts, CAST(0 AS BIGINT) AS popped_before,
         CASE WHEN q.at[1] <= r.ts THEN 1 ELSE 0 END AS pops
  FROM ranked r LEFT JOIN queue q ON q.run_key = r.run_key WHERE r.rk = 1
  UNION ALL
  SELECT r.run_key, r.rk, r.ts, p.popped_before + p.pops,
         CASE WHEN q.at[CAST(p.popped_before + p.pops + 1 AS BIGINT)] <= r.ts THEN 1 ELSE 0 END
  FROM replay p JOIN ranked r ON r.run_key = p.run_key AND r.rk = p.rk + 1
       LEFT JOIN queue q ON q.run_key = r.run_key),
attached AS (
  SELECT r.*, CASE WHEN p.pops = 1 THEN q.q[CAST(p.popped_before + 1 AS BIGINT)] END AS event
  FROM ranked r JOIN replay p ON p.run_key = r.run_key AND p.rk = r.rk
       LEFT JOIN queue q ON q.run_key = r.run_key)"""

_RESULTS = _PER_RUN + """,
results AS (SELECT dataset, cores, 100 AS sort_mb, runtime_s AS runtime_seconds, avg_cpu, avg_mem_mb,
                   avg_mem_mb * 100.0 / CAST(16384 AS DOUBLE) AS avg_mem
            FROM runs LEFT JOIN per_run USING (run_key) WHERE return_code = 0)"""
_REPORT = f"""
sp AS (SELECT *, avg_runtime_s AS runtime_s,
              first_value(avg_runtime_s) OVER (PARTITION BY dataset ORDER BY cores)
                  AS baseline_time
       FROM summary WHERE variant = 'baseline'),
sp2 AS (SELECT *, {_SPEEDUP_OF} AS speedup FROM sp),
lines AS (SELECT *, printf('%d cores: % .2fx', cores, speedup) AS line,
       printf('Initialization Overhead (no failures): % .2f seconds', avg_init_s) || chr(10) ||
       printf('%d Cores (steady state):', cores) || chr(10) ||
       printf('CPU Usage: % .2f %%', coalesce(avg_cpu, 0.0)) || chr(10) ||
       printf('Memory Usage: % .2f MB', coalesce(avg_mem_mb, 0.0)) || chr(10) ||
       printf('RunTime: % .2f seconds', avg_runtime_s) || chr(10) ||
       printf('**Throughput:** % .2f words/sec | % .2f MB/sec',
              throughput_words, throughput_mb) || chr(10) ||
       printf('**Scalability:** % .2fx relative to 1 core', speedup) AS block FROM sp2)"""
_FAILURES = """
policy AS (SELECT * FROM (VALUES (1, 1), (2, 1), (4, 1)) AS p(cores, failures)),
sections AS (SELECT b.dataset, b.cores, p.failures,
       printf('Initialization Overhead (simulated core failure): % .2f seconds', f.avg_init_s) || chr(10) ||
       printf('%d Cores with %d core failure(s):', b.cores, p.failures) || chr(10) ||
       printf('CPU Usage: % .2f %%', coalesce(f.avg_cpu, 0.0)) || chr(10) ||
       printf('Memory Usage: % .2f MB', coalesce(f.avg_mem_mb, 0.0)) || chr(10) ||
       printf('RunTime: % .2f seconds', f.avg_runtime_s) || chr(10) ||
       printf('**Throughput:** % .2f words/sec | % .2f MB/sec',
              f.throughput_words, f.throughput_mb) || chr(10) ||
       printf('Total Execution Time (no failures): % .2f seconds', b.avg_runtime_s) || chr(10) ||
       printf('Total Execution Time (with failures): % .2f seconds', f.avg_runtime_s) || chr(10) ||
       printf('Recovery Overhead: % .2f seconds', f.avg_runtime_s - b.avg_runtime_s) || chr(10) ||
       printf('Measured Retry Overhead (time spent reprocessing): % .2f seconds', f.avg_retry_s) ||
       CASE WHEN f.failure_reschedules > 0
            THEN chr(10) || printf('Rescheduled partitions (proxy for failed cores): %d', f.failure_reschedules)
            ELSE '' END AS block
  FROM summary b JOIN summary f ON f.variant = 'failure' AND b.dataset = f.dataset AND b.cores = f.cores
       JOIN policy p ON p.cores = b.cores
  WHERE b.variant = 'baseline' AND p.failures > 0)"""

ORACLE: dict[str, str] = {
    "q_ws_word_total": f"""
SELECT CAST(count(*) AS BIGINT) AS word_count
FROM (SELECT {_WS_TOKENS} AS word FROM documents) t WHERE word <> ''""",
    "q_alpha_word_freq": _ALPHA_FREQ,
    "q_ws_word_freq": f"""
SELECT word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {_WS_TOKENS} AS word FROM documents) t
WHERE word <> '' GROUP BY word""",
    "q_dataset_words": f"""
SELECT dataset, CAST(count(*) AS BIGINT) AS total_words
FROM (SELECT lang AS dataset, {_AZ_TOKENS} AS word FROM documents) t
WHERE word <> '' GROUP BY dataset""",
    "q_dataset_size": """
SELECT lang AS dataset, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(octet_length(encode(text))) AS BIGINT) AS dataset_bytes
FROM documents GROUP BY lang""",
    "q_sorted_kv_lines": f"""
SELECT word || chr(9) || CAST(n AS VARCHAR) AS line FROM ({_ALPHA_FREQ}) f""",
    "q_missing_datasets": """
SELECT doc_id, lang AS dataset FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "q_partition_profile": f"""
SELECT CAST(doc_id % {PROFILE_BUCKETS} AS INTEGER) AS partition_id, CAST(count(*) AS BIGINT) AS n_rows
FROM documents GROUP BY 1""",
    "q_split_word_total": f"""
SELECT CAST(count(*) AS BIGINT) AS word_count
FROM (SELECT {_WS_TOKENS} AS word FROM documents) t WHERE word <> ''""",
    "q_lines_one_level": """
SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS line_bytes,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS dataset_bytes
FROM documents WHERE lang = 'en'""",
    "q_ingest_datasets": """
SELECT lang AS dataset, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS load,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS id_sum
FROM documents GROUP BY lang""",
    "q_replace_dataset": """
SELECT lang AS dataset, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS load,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS id_sum, lang <> 'fr' AS files_kept
FROM documents GROUP BY lang""",
    "q_job_facts": f"""
WITH f AS ({_ALPHA_FREQ})
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM f) AS file_words, (SELECT CAST(count(*) AS BIGINT) FROM f) AS n_keys,
       CAST(count(*) AS BIGINT) AS n_rows, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS n_words,
       CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents""",
    "q_sql_words": f"""
SELECT 'letters' AS rule, word, n FROM ({_ALPHA_FREQ}) a
UNION ALL
SELECT 'whitespace' AS rule, word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {_WS_TOKENS} AS word FROM documents) t WHERE word <> '' GROUP BY word""",
    "q_partition_index": f"""
WITH e AS (SELECT min(doc_id) AS low, (max(doc_id) - min(doc_id)) // {PROFILE_BUCKETS} + 1 AS width FROM documents)
SELECT CAST(coalesce((doc_id - low) // width, 0) AS INTEGER) AS partition_id, CAST(count(*) AS BIGINT) AS n_rows,
       min(doc_id) AS first_key, max(doc_id) AS last_key,
       CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS n_bytes
FROM documents, e GROUP BY 1""",
    "q_write_modes": f"""
SELECT word || chr(9) || CAST(n AS VARCHAR) AS line, true AS refused FROM ({_ALPHA_FREQ}) f""",
    "q_samples_avg": with_fixtures("""
, ticks AS (SELECT run_key, ts, sum(cpu) AS cpu, sum(mem_bytes) AS mem_bytes
            FROM samples GROUP BY run_key, ts),
per_run AS (SELECT run_key, avg(cpu) AS avg_cpu,
                   avg(mem_bytes) / CAST(1048576 AS DOUBLE) AS avg_mem_mb
            FROM ticks GROUP BY run_key)
SELECT CASE run_key % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS cores,
       CAST(count(*) AS BIGINT) AS n_runs,
       round(avg(avg_cpu), 6) AS avg_cpu, round(avg(avg_mem_mb), 6) AS avg_mem_mb
FROM per_run GROUP BY 1""", "samples"),
    "q_run_summary": with_fixtures(f"""
, {_FACTS}, {_CFG}
SELECT dataset, cores, variant, n_runs, round(avg_runtime_s, 6) AS avg_runtime_s,
       round(avg_init_s, 6) AS avg_init_s, round(avg_processing_s, 6) AS avg_processing_s,
       round(avg_cpu, 6) AS avg_cpu, round(avg_mem_mb, 6) AS avg_mem_mb, round(avg_retry_s, 6) AS avg_retry_s,
       first_run_id, failure_reschedules, failed_core_budget, total_cores, word_count, dataset_bytes,
       round(throughput_words, 6) AS throughput_words, round(throughput_mb, 6) AS throughput_mb
FROM summary""", "runs", "samples"),
    "q_speedup": with_fixtures(f"""
, cfg AS (SELECT dataset, cores, avg(runtime_s) AS runtime_s FROM runs
          WHERE return_code = 0 AND variant = 'baseline' GROUP BY dataset, cores),
sp AS (SELECT *, first_value(runtime_s) OVER (PARTITION BY dataset ORDER BY cores)
                 AS baseline_time FROM cfg)
SELECT dataset, cores, round(runtime_s, 6) AS runtime_s,
       round(baseline_time, 6) AS baseline_time,
       round({_SPEEDUP_OF}, 6) AS speedup,
       round({_SPEEDUP_OF} / cores, 6) AS parallel_efficiency
FROM sp""", "runs"),
    "q_recovery_overhead": with_fixtures("""
, ok AS (SELECT * FROM runs WHERE return_code = 0),
b AS (SELECT dataset, cores, avg(runtime_s) AS rt FROM ok WHERE variant = 'baseline'
      GROUP BY dataset, cores),
f AS (SELECT dataset, cores, avg(runtime_s) AS rt FROM ok WHERE variant = 'failure'
      GROUP BY dataset, cores)
SELECT b.dataset, b.cores, round(b.rt, 6) AS baseline_runtime_s,
       round(f.rt, 6) AS failure_runtime_s, round(f.rt - b.rt, 6) AS recovery_overhead_s
FROM b LEFT JOIN f ON b.dataset = f.dataset AND b.cores = f.cores""", "runs"),
    "q_policy_grid": with_fixtures("""
, grid AS (SELECT DISTINCT dataset, unnest([1, 2, 4, 8]) AS cores FROM runs),
policy AS (SELECT * FROM (VALUES (1, 1), (2, 1), (4, 1)) AS p(cores, failures))
SELECT g.dataset, g.cores, coalesce(p.failures, 0) AS failures
FROM grid g LEFT JOIN policy p ON g.cores = p.cores
WHERE coalesce(p.failures, 0) > 0""", "runs"),
    "q_outcomes": with_fixtures("""
SELECT run_id, dataset, cores, round(runtime_s, 6) AS runtime_s,
       CASE WHEN return_code = 0 THEN 'Recovered' ELSE 'Failed' END AS outcome,
       dataset || '_' || CAST(cores AS VARCHAR) || 'c_FT' AS label
FROM runs WHERE variant = 'failure' ORDER BY dataset, cores, run_id""", "runs"),
    "q_union_results": with_fixtures("""
SELECT run_id, dataset, cores, 100 AS sort_mb, round(runtime_s, 6) AS runtime_seconds,
       dataset || '_' || CAST(cores AS VARCHAR) || 'cores_100mb' AS label
FROM runs WHERE return_code = 0 AND variant = 'baseline'
UNION ALL BY NAME
SELECT run_id, dataset, cores, round(runtime_s, 6) AS runtime_seconds,
       CASE WHEN return_code = 0 THEN 'Recovered' ELSE 'Failed' END AS outcome,
       dataset || '_' || CAST(cores AS VARCHAR) || 'c_FT' AS label
FROM runs WHERE variant = 'failure'""", "runs"),
    "q_first_crossing": with_fixtures("""
SELECT run_key, epoch_us(ts) AS first_ts_us, progress AS progress_at
FROM samples WHERE progress >= 50.0
QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY ts, progress DESC) = 1""", "samples"),
    "q_latest_match": """
SELECT user_id, epoch_us(ts) AS last_ts_us, event_id AS last_event_id
FROM events WHERE contains(event_type, 'error')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "q_attach_events": with_fixtures(_ATTACH_CTES + """
SELECT run_key, epoch_us(ts) AS ts_us, n_procs, round(cpu, 6) AS cpu, round(mem_bytes, 6) AS mem_bytes, event
FROM attached""", "samples", "triggers", recursive=True),
    "q_metrics_series": with_fixtures(_ATTACH_CTES + """
SELECT 'ds' || CAST(run_key % 3 AS VARCHAR) AS dataset,
       CASE run_key % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS cores,
       run_key, epoch_us(ts) AS ts_us, round(cpu, 6) AS cpu, round(mem_bytes, 6) AS memory,
       disk_read, disk_write, event
FROM attached""", "samples", "triggers", recursive=True),
    "q_cumulative_report": with_fixtures(f"""
, {_FACTS}, {_CFG}, {_REPORT}
SELECT dataset, cores, line,
       '**Scalability:** T₁ / T across core configurations' || chr(10) ||
       string_agg(line, chr(10) ORDER BY cores) OVER (
           PARTITION BY dataset ORDER BY cores
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative, block
FROM lines""", "runs", "samples"),
    "q_failure_report": with_fixtures(f"""
, {_FACTS}, {_CFG}, {_FAILURES}
SELECT dataset, cores, failures, block FROM sections""", "runs", "samples"),
    "q_report_file": with_fixtures(f"""
, {_FACTS}, {_CFG}, {_REPORT}, {_FAILURES},
blocks AS (SELECT block FROM lines UNION ALL SELECT block FROM sections),
each AS (SELECT unnest(string_split(block, chr(10))) AS line FROM blocks)
SELECT line, CAST(count(*) AS BIGINT) AS n FROM each GROUP BY line""", "runs", "samples"),
    "q_samples_fallback": """
WITH fb AS (SELECT user_id AS run_key, value AS fallback FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) = 1),
m AS (SELECT user_id AS run_key, count(*) AS n_samples, avg(value) AS avg_cpu
      FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT fb.run_key, CAST(coalesce(m.n_samples, 0) AS BIGINT) AS n_samples,
       round(coalesce(m.avg_cpu, fb.fallback, 0.0), 6) AS avg_cpu,
       m.avg_cpu IS NULL AS used_fallback
FROM fb LEFT JOIN m ON fb.run_key = m.run_key""",
    "q_json_default": """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k
FROM events""",
    "q_distinct_first_field": with_fixtures(r"""
SELECT DISTINCT core FROM (
  SELECT TRY_CAST(regexp_extract(line, '^\s*(\S+)', 1) AS INTEGER) AS core
  FROM (SELECT unnest(string_split(listing, chr(10))) AS line FROM process_listings) l
  WHERE contains(line, 'ck')) t
WHERE core IS NOT NULL ORDER BY core""", "process_listings"),
    "q_file_dataset_words": f"""
WITH w AS (SELECT dataset, CAST(count(*) AS BIGINT) AS total_words
           FROM (SELECT lang AS dataset, {_AZ_TOKENS} AS word FROM documents) t
           WHERE word <> '' GROUP BY dataset),
b AS (SELECT lang AS dataset, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS dataset_bytes
      FROM documents GROUP BY lang)
SELECT w.dataset, w.total_words, b.dataset_bytes FROM w JOIN b ON w.dataset = b.dataset""",
    "q_results_csv_roundtrip": with_fixtures(f"""
, {_RESULTS}
SELECT dataset, cores, sort_mb, round(runtime_seconds, 6) AS runtime_seconds, round(avg_cpu, 6) AS avg_cpu,
       round(avg_mem, 6) AS avg_mem_percent FROM results""", "runs", "samples"),
    "q_results_append": with_fixtures(f"""
, {_RESULTS}
SELECT dataset, cores, CAST(count(*) AS BIGINT) AS n_rows, round(avg(runtime_seconds), 6) AS runtime
FROM results GROUP BY dataset, cores""", "runs", "samples"),
    "q_results_mixed": with_fixtures(f"""
, {_RESULTS}
SELECT dataset, cores, CASE WHEN dataset = 'en' THEN sort_mb END AS sort_mb,
       round(runtime_seconds, 6) AS runtime_seconds,
       CASE WHEN dataset <> 'de' THEN round(avg_cpu, 6) END AS avg_cpu,
       CASE WHEN dataset = 'en' THEN round(avg_mem, 6) END AS avg_mem_percent,
       CASE WHEN dataset IN ('fr', 'es') THEN round(avg_mem_mb, 6) END AS avg_mem_mb,
       CAST(NULL AS VARCHAR) AS bad_record
FROM results""", "runs", "samples"),
    "q_sample_k": """
SELECT event_id, md5(CAST(event_id AS VARCHAR) || '42') AS sample_key
FROM events ORDER BY sample_key, event_id LIMIT 8""",
}
