"""Property test: Spark tokens equal a plain-Python statement of each rule."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexitally.functions.tokenize import LETTERS, WHITESPACE, token_array

# Java's \s: space, tab, newline, vertical tab, form feed, carriage return.
JAVA_WS = re.compile("[ \t\n\x0b\x0c\r]+")
ALPHABET = "abcXYZ019 '-.,!\t\n\r\x0b\x0c  éÜßø"


def ws_rule(s):
    return [t for t in JAVA_WS.split(s or "") if t]


def letter_rule(s):
    # ASCII-range lower-casing is all the alphabet needs (no İ-like letters)
    return [t for t in re.split("[^a-z]", (s or "").lower()) if t]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=40)),
                min_size=1, max_size=60))
def test_rules_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", token_array("t", WHITESPACE).alias("ws"),
                     token_array("t", LETTERS).alias("az")).collect()
    got = {r.i: (r.ws, r.az) for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == (ws_rule(t), letter_rule(t)), repr(t)
