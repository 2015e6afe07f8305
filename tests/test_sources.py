"""Scans over a directory fixture, dataset tagging, byte totals, result CSVs."""

import os

import pytest
from pyspark.sql.utils import AnalysisException

from lexitally.sources.results import read_results
from lexitally.sources.text import dataset_bytes, read_dataset, read_datasets, read_lines


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture
def ds(tmp):
    d = os.path.join(tmp, "ds")
    _write(f"{d}/a.txt", b"x y\r\nz\rq\n\n")
    _write(f"{d}/sub/b.txt", b"n1 n2\n")
    _write(f"{d}/_hid.txt", b"hidden\n")
    _write(f"{d}/e.txt", b"")
    return d


def test_one_level_scan(spark, ds):
    got = sorted(r.value for r in read_lines(spark, ds).collect())
    assert got == sorted(["x y", "z", "q", ""])


def test_recursive_scan(spark, ds):
    got = sorted(r.value for r in read_lines(spark, ds, recursive=True).collect())
    assert got == sorted(["x y", "z", "q", "", "n1 n2"])


def test_missing_path_raises(spark, tmp):
    with pytest.raises(AnalysisException):
        read_lines(spark, os.path.join(tmp, "nope")).collect()


def test_bytes_from_listing(spark, ds):
    total = dataset_bytes(spark, ds, by_dataset=False).first().dataset_bytes
    assert total == 10 + 6  # hidden file excluded, empty file adds 0


def test_bytes_scan_reads_no_content(spark, ds):
    df = dataset_bytes(spark, ds, by_dataset=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_datasets_tagged_by_folder(spark, tmp):
    root = os.path.join(tmp, "root")
    _write(f"{root}/toy/a.txt", b"one two\n")
    _write(f"{root}/toy/deep/b.txt", b"three\n")
    _write(f"{root}/small/c.txt", b"four five six\n")
    _write(f"{root}/loose.txt", b"ignored\n")
    rows = sorted((r.dataset, r.value) for r in read_datasets(spark, root).collect())
    assert rows == [("small", "four five six"), ("toy", "one two"), ("toy", "three")]
    sizes = {r.dataset: r.dataset_bytes for r in dataset_bytes(spark, root).collect()}
    assert sizes == {"toy": 14, "small": 14}


# The three header lines of the published result files.
MAIN = ("dataset,cores,runtime_seconds,avg_cpu,avg_mem,throughput_words_per_sec,"
        "speedup_vs_1_core,initialization overhead")
SPILL = "Cores,Dataset,Executor Memory,cpu usage,memory usage,runtime,throughput,scalability"
FAIL = "Cores,Data set,Num Failures,cpu usage,memory usage,runtime,throughput,scalability"


def test_result_tables_three_spellings_in_one_folder(spark, tmp):
    _write(f"{tmp}/r/a.csv", f"{MAIN}\nalpha,1,10.5,0.25,700,1000000,1,2.5\n".encode())
    _write(f"{tmp}/r/b.csv", f'{SPILL}\n2,"beta, two",256 MB,0.5,900,7.25,2000000,1.5\n3,gamma,x,bad,,9,1,1\n'.encode())
    _write(f"{tmp}/r/c.csv", f"{FAIL}\r\n4,delta,1,0.75,800,99,3000000,2.25\r\n".encode())
    got = {r.dataset: r for r in read_results(spark, f"{tmp}/r").collect()}
    assert len(got) == 4
    a, b, c, g = got["alpha"], got["beta, two"], got["delta"], got["gamma"]
    assert (a.cores, a.runtime_seconds, a.init_overhead_s, a.avg_mem_mb) == (1, 10.5, 2.5, 700.0)
    assert (b.cores, b.executor_memory, b.speedup_vs_1_core, b.avg_mem_mb) == (2, "256 MB", 1.5, 900.0)
    assert (c.cores, c.failures, c.runtime_seconds) == (4, 1, 99.0)
    assert (g.cores, g.avg_cpu, g.avg_mem_mb) == (3, None, None)
    assert (a.bad_record, b.bad_record, c.bad_record) == (None, None, None) and g.bad_record.startswith("3,gamma")
    with pytest.raises(ValueError):
        _write(f"{tmp}/none/x.csv", b"1,2\n")
        read_results(spark, f"{tmp}/none")


def test_memory_unit_by_the_whole_header(spark, tmp):
    _write(f"{tmp}/r/a.csv", b"dataset,cores,sort_mb,runtime_seconds,avg_cpu,avg_mem\nx,1,100,2.5,20,66.5\n")
    _write(f"{tmp}/r/b.csv", f"{MAIN}\ny,1,1,1,700,1,1,1\n".encode())
    got = {r.dataset: (r.avg_mem_percent, r.avg_mem_mb) for r in read_results(spark, f"{tmp}/r").collect()}
    assert got == {"x": (66.5, None), "y": (None, 700.0)}


def test_result_rows_are_reported_not_dropped(spark, tmp):
    _write(f"{tmp}/a b/x.csv", f'{FAIL}\n1,"two\nlines, ""quoted""",1,0.5,800,99,3,2\n2,short\n3,long,1,0.5,800,99,3,2,9,9\n'.encode())
    got = {r.cores: r for r in read_results(spark, f"{tmp}/a b").collect()}
    assert got[1].dataset == 'two\nlines, "quoted"' and got[1].bad_record is None
    assert got[2].dataset == "short" and got[2].runtime_seconds is None and "short" in got[2].bad_record
    assert got[3].runtime_seconds == 99.0 and "long" in got[3].bad_record
    plan = read_results(spark, f"{tmp}/a b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("other", [b"1,2,3\n", f"{FAIL}\n1,a,1,1,1,1,1,1\n{SPILL}\n1,b,x,1,1,1,1,1\n".encode()])
def test_result_files_without_one_header_are_named(spark, tmp, other):
    _write(f"{tmp}/r/good.csv", f"{MAIN}\nalpha,1,1,1,1,1,1,1\n".encode())
    _write(f"{tmp}/r/empty.csv", b"")
    _write(f"{tmp}/r/bad.csv", other)
    with pytest.raises(ValueError, match="bad.csv"):
        read_results(spark, f"{tmp}/r")


def test_blanks_in_the_root_and_one_level_bytes(spark, tmp):
    root = os.path.join(tmp, "my data+x")
    _write(f"{root}/toy set/a b.txt", b"one two\n")
    _write(f"{root}/loose.txt", b"zz\n")
    assert [tuple(r) for r in read_datasets(spark, root).collect()] == [("toy set", "one two")]
    assert [tuple(r) for r in dataset_bytes(spark, root).collect()] == [("toy set", 8)]
    assert dataset_bytes(spark, root, by_dataset=False, recursive=False).first().dataset_bytes == 3
    assert [r.value for r in read_lines(spark, root).collect()] == ["zz"]


def test_split_hint(spark, tmp):
    from lexitally.sources.tables import split_session
    _write(f"{tmp}/big/a.txt", b"x y\n" * 5000)
    own = split_session(spark, 2000)
    assert read_lines(own, f"{tmp}/big").rdd.getNumPartitions() == 10
    assert read_lines(spark, f"{tmp}/big").rdd.getNumPartitions() < 10
    assert read_lines(own, f"{tmp}/big").count() == 5000


def test_dataset_by_name(spark, tmp):
    root = os.path.join(tmp, "root")
    _write(f"{root}/toy/a.txt", b"one two\n")
    assert [r.value for r in read_dataset(spark, root, "toy").collect()] == ["one two"]
    with pytest.raises(AnalysisException):
        read_dataset(spark, root, "medium").collect()
