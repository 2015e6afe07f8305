"""Number format, partition index, dataset replacement, observed facts."""

import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexitally.functions.scalar import signed2
from lexitally.operators import runs as R, sampling, wordcount as W
from lexitally.sinks import files as sinks


def test_signed2_equals_the_binary_value_rounded(spark, tmp):
    rnd = random.Random(4)
    values = [0.0, -0.0, 0.005, 0.015, 0.125, 0.375, -0.001, 2.675, 81.975, 0.995, 99.995, 1.005, 1e15, 2.0 ** 53, 9.2e18,
              5e-324, float("inf"), float("-inf"), float("nan"), None]
    values += [rnd.gauss(0, 1) * 10.0 ** rnd.randint(-6, 14) for _ in range(60000)]
    values += [rnd.randint(-10 ** 9, 10 ** 9) / rnd.choice([8, 200, 1000]) for _ in range(60000)]
    values += [x for x in (struct.unpack("d", rnd.randbytes(8))[0] for _ in range(60000)) if abs(x) < 2.0 ** 63]
    pq.write_table(pa.table({"v": pa.array(values, pa.float64())}), f"{tmp}/v.parquet", row_group_size=20000)
    for r in spark.read.parquet(f"{tmp}/v.parquet").select("v", signed2("v").alias("s")).toLocalIterator():
        assert r.s == (None if r.v is None or r.v != r.v else format(r.v, " .2f")), r


def test_index_of_each_partition(spark):
    df = spark.createDataFrame([(k, "ab" * (k or 1)) for k in [*range(5, 25), 5, 99, None]], "k long, t string")
    got = {r.partition_id: tuple(r)[1:] for r in sampling.profile_with_index(sampling.key_ranges(df, "k", 10), "k", "t").collect()}
    assert got[0] == (12, 5, 14, 2 * (sum(range(5, 15)) + 5 + 1))
    assert got[1][:3] == (10, 15, 24) and got[9] == (1, 99, 99, 198) and set(got) == {0, 1, 9}
    empty = sampling.key_ranges(df.limit(0), "k", 4)
    assert sampling.profile_with_index(empty, "k", "t").count() == 0


def test_replacing_one_dataset_keeps_the_others_files(spark, tmp):
    rows = [(i, i % 3 and "a" or "b", 1) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, dataset string, load int")
    sinks.ingest(df, tmp)
    before = {r.f for r in spark.read.parquet(tmp).where("dataset = 'a'").select(F.col("_metadata.file_path").alias("f")).collect()}
    sinks.replace_datasets(spark.createDataFrame([(100, "b", 2), (101, "c", 2)], "id long, dataset string, load int"), tmp)
    back = spark.read.parquet(tmp)
    assert {(r.id, r.load) for r in back.where("dataset <> 'a'").collect()} == {(100, 2), (101, 2)}
    assert {r.f for r in back.where("dataset = 'a'").select(F.col("_metadata.file_path").alias("f")).collect()} == before


def test_facts_of_the_pass_that_writes(spark, tmp):
    lines = spark.createDataFrame([("b a é",), (None,), ("A",)], "value string")
    facts = Observation()
    sinks.write_word_counts(W.word_freq(W.observed(lines, facts)), f"{tmp}/out", None)
    assert facts.get == {"n_rows": 3, "n_words": 3, "n_bytes": 7}
    assert sorted(r.value for r in spark.read.text(f"{tmp}/out").collect()) == ["a\t2", "b\t1"]


def test_summary_keeps_configurations_with_nulls(spark):
    runs = spark.createDataFrame([(1, "a", None, "baseline", 5, 2.0), (2, None, 1, "baseline", 4, 3.0), (3, None, 1, "baseline", 6, 5.0)],
                                 "run_id long, dataset string, cores int, variant string, ts long, runtime_s double")
    runs = runs.withColumns({"init_s": F.lit(0.0), "processing_s": F.col("runtime_s")})
    facts = spark.createDataFrame([("a", 10, 20)], "dataset string, word_count long, dataset_bytes long")
    got = {(r.dataset, r.cores): (r.n_runs, r.avg_runtime_s, r.first_run_id) for r in R.config_summary(runs, facts).collect()}
    assert got == {("a", None): (1, 2.0, 1), (None, 1): (2, 4.0, 2)}
