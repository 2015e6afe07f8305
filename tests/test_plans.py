"""Plan shape guards: the properties that matter at 100 TB, checked on the
physical plans of every registered batch query."""

import contextlib
import io
import re

import pytest

from lexitally.plans.catalog import QUERIES
from conftest import SF_SMOKE

# queries whose builders write derived data first (fine to plan, but skip the
# per-query write cost here) are still planned; streams live elsewhere
BATCH = sorted(QUERIES)
GLOBAL_TOTALS = {"q_ws_word_total", "q_split_word_total", "q_lines_one_level", "q_job_facts"}   # a one-row total may end in one partition
ORDERED = {"q_outcomes", "q_distinct_first_field", "q_sample_k"}  # requested order / top-k


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(QUERIES[name](spark, SF_SMOKE)) for name in BATCH}


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_or_nested_loop(plans, name):
    p = plans[name]
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", BATCH)
def test_no_sort_aggregate(plans, name):
    assert "SortAggregate" not in plans[name]


@pytest.mark.parametrize("name", sorted(set(BATCH) - GLOBAL_TOTALS - ORDERED))
def test_nothing_gathered_into_one_partition(plans, name):
    assert "SinglePartition" not in plans[name]


TABLE_COLUMNS = {"documents": 5, "events": 6, "labels": 3, "pages": 3, "conversations": 4}


@pytest.mark.parametrize("name", BATCH)
def test_test_table_scans_are_pruned(plans, name):
    """Every scan of a given table reads fewer columns than the table has."""
    for section in plans[name].split("\n("):
        m = re.search(r"Location: .*?/(\w+)\.parquet", section)
        schema = re.search(r"ReadSchema: struct<(.*)>", section)
        if m and schema and m.group(1) in TABLE_COLUMNS:
            assert schema.group(1).count(":") < TABLE_COLUMNS[m.group(1)], section


def test_documents_scan_reads_text_only(plans):
    assert "ReadSchema: struct<text:string>" in plans["q_alpha_word_freq"]


def test_filters_reach_the_scan(plans):
    assert re.search(r"PushedFilters: \[.*event_type", plans["q_run_summary"])


def test_partial_aggregate_before_word_shuffle(plans):
    p = plans["q_alpha_word_freq"]
    partial = p.index("partial_count")
    shuffle = p.index("hashpartitioning(word")
    final = p.index("Functions [1]: [count(1)]")
    assert partial < shuffle < final


def test_global_total_does_not_explode(plans):
    assert "Generate" not in plans["q_ws_word_total"]


@pytest.mark.parametrize("name", sorted(set(BATCH) - {"q_partition_index"}))    # its layout is the feature
def test_no_round_robin(plans, name):
    """No plan deals raw rows out anew because the cluster has more cores than splits."""
    assert "RoundRobinPartitioning" not in plans[name] and "REPARTITION" not in plans[name]


def test_sorted_files_shuffle_words_once(plans):
    assert "rangepartitioning" not in plans["q_sorted_kv_lines"]
    assert len(re.findall(r"\(\d+\) Exchange\n", plans["q_sorted_kv_lines"])) == 1


def test_attached_line_is_exchanged_by_bucket_then_by_rank(plans):
    p = plans["q_attach_events"]
    keys = set(re.findall(r"Arguments: hashpartitioning\(([^)]*\)?[^)]*)\), ENSURE", p))
    by_bucket = [x for x in re.findall(r"hashpartitioning\((.*), \d+\), ENSURE", p) if "bucket" in x]
    assert keys and by_bucket
    assert "rangepartitioning" not in p


@pytest.mark.parametrize("name", BATCH)
def test_python_only_where_the_feature_is_a_python_function(plans, name):
    uses = re.search("EvalPython|InArrow|InPandas|PythonUDF", plans[name])
    assert bool(uses) == (name == "q_partition_index")


def test_sql_functions_are_inlined(plans, spark):
    from lexitally.functions.tokenize import register_sql
    own = spark.newSession()
    register_sql(own)
    own.read.parquet(f"{SF_SMOKE}/documents.parquet").createOrReplaceTempView("docs")
    sql = plan_of(own.sql("SELECT word, count(*) AS n FROM (SELECT letters(text) AS words FROM docs) LATERAL VIEW explode(words) AS word GROUP BY word"))
    nodes = lambda p: [n for n in re.findall(r"^\(\d+\) (\w+)", p, re.M) if n not in ("Filter", "Project")]
    assert nodes(sql) == nodes(plans["q_alpha_word_freq"])
    assert "ReadSchema: struct<text:string>" in sql


def test_write_side_plans(spark, tmp_path):
    """Plans of what the file queries write, taken by a listener on the writer's data."""
    from pyspark.sql import DataFrameWriter
    seen = []
    kept = {n: getattr(DataFrameWriter, n) for n in ("text", "parquet", "csv")}
    try:
        for n, f in kept.items():
            setattr(DataFrameWriter, n, lambda self, path, *a, f=f, **k: (seen.append(plan_of(self._df)), f(self, path, *a, **k))[1])
        for name in ("q_metrics_series", "q_file_dataset_words", "q_write_modes", "q_report_file", "q_ingest_datasets"):
            QUERIES[name](spark, SF_SMOKE)
    finally:
        for n, f in kept.items():
            setattr(DataFrameWriter, n, f)
    assert len(seen) >= 8
    for p in seen:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        assert "RoundRobinPartitioning" not in p and "SinglePartition" not in p
