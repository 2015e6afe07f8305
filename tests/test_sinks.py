"""File sinks: sorted key/count files, write modes, CSV results, report."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexitally.functions.tokenize import LETTERS
from lexitally.operators.wordcount import word_freq
from lexitally.sinks import files
from lexitally.sources.tables import read_table
from conftest import SF_SMOKE


def _parts(path, pattern="part-*"):
    return sorted(glob.glob(os.path.join(path, pattern)))


def test_word_count_files(spark, tmp):
    docs = read_table(spark, SF_SMOKE, "documents", ["text"])
    freq = word_freq(docs, "text", LETTERS)
    out = tmp + "/wc"
    files.write_word_counts(freq, out, 3)
    parts = _parts(out)
    assert len(parts) == 3
    got = {}
    for p in parts:
        keys = []
        for line in open(p, encoding="utf-8").read().splitlines():
            w, n = line.split("\t")
            keys.append(w)
            got[w] = int(n)
        assert keys == sorted(keys)
    assert got == {r.word: r.n for r in freq.collect()}
    with pytest.raises(AnalysisException):
        files.write_word_counts(freq, out, 3)  # errorifexists
    files.write_word_counts(freq.limit(5), out, 2, mode="overwrite")
    assert sum(len(open(p).read().splitlines()) for p in _parts(out)) == 5


def test_result_csv_overwrite_and_append(spark, tmp):
    rows = spark.createDataFrame([("toy", 1, 2.5, "Recovered")],
                                 "dataset string, cores int, runtime double, outcome string")
    out = tmp + "/res"
    cols = ["dataset", "cores", "runtime", "outcome"]
    files.write_table_csv(rows, out, cols)
    files.write_table_csv(rows.withColumn("cores", F.lit(2)), out, cols, mode="append")
    back = spark.read.option("header", "true").csv(out)
    assert back.columns == cols
    assert sorted(int(r.cores) for r in back.collect()) == [1, 2]
    files.write_table_csv(rows, out, cols)  # overwrite keeps one run
    assert spark.read.option("header", "true").csv(out).count() == 1


def test_series_partitioned_with_empty_event(spark, tmp):
    df = spark.createDataFrame([("toy", 1, 1.0, None), ("toy", 1, 2.0, "TASK_KILLED"),
                                ("toy", 2, 3.0, None)],
                               "dataset string, cores int, cpu double, event string")
    out = tmp + "/series"
    files.write_series(df, out)
    assert os.path.isdir(out + "/dataset=toy/cores=1")
    lines = [l for p in _parts(out + "/dataset=toy/cores=1")
             for l in open(p).read().splitlines()]
    assert "cpu,event" in lines and "1.0," in lines and "2.0,TASK_KILLED" in lines


def test_report_overwrite_then_append(spark, tmp):
    out = tmp + "/report"
    a = spark.createDataFrame([("block one",)], "block string")
    b = spark.createDataFrame([("block two",)], "block string")
    files.write_report(a, out)
    files.write_report(b, out, mode="append")
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["block one", "block two"]


def test_ingest_only_missing_datasets(spark, tmp):
    out = tmp + "/input"
    first = spark.createDataFrame([("toy", "a b")], "dataset string, value string")
    files.ingest_missing(first, out)
    both = spark.createDataFrame([("toy", "changed"), ("small", "c d")],
                                 "dataset string, value string")
    files.ingest_missing(both, out)
    got = sorted((r.dataset, r.value) for r in spark.read.parquet(out).collect())
    assert got == [("small", "c d"), ("toy", "a b")]
    files.ingest(both, out)  # unconditional
    assert spark.read.parquet(out).count() == 4


def test_ingest_into_a_table_of_another_shape_fails(spark, tmp):
    out = tmp + "/odd"
    spark.createDataFrame([("x", 1)], "name string, n long").write.parquet(out)
    with pytest.raises(AnalysisException):
        files.ingest_missing(spark.createDataFrame([("toy", "a")], "dataset string, value string"), out)
    assert spark.read.parquet(out).count() == 1
