"""Every registered query of the subpackage: its columns, its rows, and its oracle where there is one."""

import pytest

from __spark_entry__ import oracle_sql, queries
from lexitally.llm.queries import ORACLE, QUERIES
from verify import compare, duck_connect

SF = "/root/testdata/sf0.001"
# The columns each query promises, and the table whose rows it covers.
COLUMNS = {
    "op1": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op2": ("documents", "doc_id n_bytes n_removed n_spans kept_sha256"),
    "op3": ("pages", "page_id url text n_chars"),
    "op4": ("documents", "doc_id held_out lang_pred score"),
    "op5": ("documents", "doc_id n_shingles component_id"),
    "op6": (None, "doc_id piece start length ids_crc32 sequence_id offset"),
    "op7": ("pages", "page_id payload_bytes payload_digest record_type refers_to"),
    "op8": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    "op9": (None, "query_id rank vec_id score"),
    "op10": ("documents", "doc_id held_out score predicted"),
    "op11": (None, "item_id rank doc_id score"),
    "op12": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256 agrees"),
    "op13": ("documents", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
}
TYPES = {"held_out": "boolean", "score": "double", "predicted": "int", "rank": "int", "piece": "int", "kept": "boolean",
         "base_failed": "boolean", "agrees": "boolean", "text": "string", "url": "string", "record_type": "string"}


def test_all_queries_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    source, columns = COLUMNS[name.split("_")[0]]
    df = queries()[name](spark, SF)
    types = dict(df.dtypes)
    for c in columns.split():
        assert c in types
        want = "bigint" if (name, c) == ("op11_lexical_search", "score") else TYPES.get(c, "string" if c.endswith(("sha256", "digest", "pred")) else "bigint")
        assert types[c] == want, (c, types[c])
    rows = df.count()
    assert rows == spark.read.parquet(f"{SF}/{source}.parquet").count() if source else rows > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    ok, msg = compare(queries()[name](spark, SF), duck_connect(SF), ORACLE[name])
    assert ok, msg
