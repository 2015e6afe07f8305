"""The driver contract: entry, queries and oracle SQL agree at sf0.001."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from lexitally.plans.catalog import QUERIES
from lexitally.streaming.queries import STREAM_QUERIES
from verify import compare, duck_connect
from conftest import SF_SMOKE

OWN = {**QUERIES, **STREAM_QUERIES}        # other subpackages test their own queries


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["word", "n"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(queries()) and set(OWN) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMOKE)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(queries()[name](spark, SF_SMOKE), con, oracle_sql()[name])
    assert ok, msg


def test_partition_profile_covers_all_rows(spark):
    df = queries()["q_partition_profile"](spark, SF_SMOKE)
    assert sum(r.n_rows for r in df.collect()) == 200


def test_physical_profile(spark):
    from lexitally.operators.sampling import partition_profile
    got = partition_profile(spark.range(100).repartition(7)).collect()
    assert len(got) == 7 and sum(r.n_rows for r in got) == 100
