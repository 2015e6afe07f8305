"""Tokeniser goldens: hand-written edge strings for both rules."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.functions.tokenize import LETTERS, WHITESPACE, token_array, token_count, tokens

# (input, whitespace-rule tokens, letter-rule tokens)
GOLDEN = [
    ("  lead", ["lead"], ["lead"]),
    ("café Ünï", ["café", "Ünï"], ["caf", "n"]),
    ("Straße", ["Straße"], ["stra", "e"]),
    ("İstanbul", ["İstanbul"], ["i", "stanbul"]),
    ("a\x0bb", ["a", "b"], ["a", "b"]),
    ("a\u00a0b", ["a\u00a0b"], ["a", "b"]),
    ("a\u2003b", ["a\u2003b"], ["a", "b"]),
    ("", [], []),
    (None, [], []),
    ("Don't stop, 42 times!\n", ["Don't", "stop,", "42", "times!"], ["don", "t", "stop", "times"]),
    ("x y\r\nz\tq  ", ["x", "y", "z", "q"], ["x", "y", "z", "q"]),
]


@pytest.fixture(scope="module")
def lines(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()),
                           T.StructField("value", T.StringType())])
    return spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], schema)


@pytest.mark.parametrize("rule,idx", [(WHITESPACE, 1), (LETTERS, 2)])
def test_token_arrays(lines, rule, idx):
    got = {r.id: r.t for r in lines.select("id", token_array("value", rule).alias("t")).collect()}
    for i, g in enumerate(GOLDEN):
        assert got[i] == g[idx], (rule, g[0])


@pytest.mark.parametrize("rule,idx", [(WHITESPACE, 1), (LETTERS, 2)])
def test_exploded_tokens_match_arrays(lines, rule, idx):
    rows = tokens(lines, "value", rule, keep=("id",)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.word)
    for i, g in enumerate(GOLDEN):
        assert sorted(got.get(i, [])) == sorted(g[idx])


def test_counts_without_explode(lines):
    n = lines.agg(F.sum(token_count("value", WHITESPACE))).first()[0]
    assert n == sum(len(g[1]) for g in GOLDEN)


def test_unknown_rule(lines):
    with pytest.raises(ValueError):
        token_array("value", "nope")
