"""The command line programs: per-word job, global count, result conversion; the experiment script."""

import argparse
import glob
import os

import pytest
from pyspark.sql.utils import AnalysisException

from lexitally import cli
from scripts.experiment import scaling_run


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def corpus(tmp):
    d = tmp + "/toy"
    _write(d + "/a.txt", "The cat, the HAT.\nit's 42 cats\n")
    _write(d + "/sub/b.txt", "the end\n")
    return d


def test_wordcount_job(spark, corpus, tmp):
    out = tmp + "/out"
    args = argparse.Namespace(input=corpus, output=out, rule="letters", files=2, overwrite=False)
    cli.cmd_wordcount(spark, args)
    got = {}
    for p in sorted(glob.glob(out + "/part-*")):
        for line in open(p, encoding="utf-8").read().splitlines():
            w, n = line.split("\t")
            got[w] = int(n)
    assert got == {"the": 3, "cat": 1, "hat": 1, "it": 1, "s": 1, "cats": 1, "end": 1}
    with pytest.raises(AnalysisException):
        cli.cmd_wordcount(spark, args)          # output exists
    cli.cmd_wordcount(spark, argparse.Namespace(**{**vars(args), "overwrite": True}))


def test_count(spark, corpus, capsys):
    cli.cmd_count(spark, argparse.Namespace(path=corpus, rule="whitespace", recursive=True))
    assert capsys.readouterr().out.strip() == "9"
    cli.cmd_count(spark, argparse.Namespace(path=corpus, rule="whitespace", recursive=False))
    assert capsys.readouterr().out.strip() == "7"


def test_experiment_writes_results_and_report(spark, corpus, tmp):
    rows = scaling_run(corpus, [1, 2], 1, dataset="toy", recursive=True,
                          results_path=tmp + "/res", report_path=tmp + "/log")
    assert [r.cores for r in rows] == [1, 2]
    assert rows[0].speedup == 1.0 and rows[0].word_count == 9
    res = spark.read.option("header", "true").csv(tmp + "/res")
    assert res.columns[:3] == ["dataset", "cores", "runtime_s"] and res.count() == 2
    text = [r.value for r in spark.read.text(tmp + "/log").collect()]
    assert text[1] == "1 Cores (steady state):"
    assert text[7:9] == ["**Scalability:** T₁ / T across core configurations", "1 cores:  1.00x"]
    assert text[-3].startswith("**Scalability:** T")
    assert text[-2:] == ["1 cores:  1.00x", f"2 cores: {rows[1].speedup: .2f}x"]


def test_results_conversion(spark, tmp):
    _write(tmp + "/in/r.csv", "Cores,Data set,Num Failures,runtime\n2,toy,1,76.92\n")
    args = argparse.Namespace(input=tmp + "/in", output=tmp + "/out", format="parquet",
                              overwrite=False)
    cli.cmd_results(spark, args)
    row = spark.read.parquet(tmp + "/out").first()
    assert (row.cores, row.dataset, row.failures, row.runtime_seconds) == (2, "toy", 1, 76.92)
