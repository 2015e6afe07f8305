"""The two tokenisation rules, as built-in column expressions.

Both rules are plain ``split`` + ``filter`` expressions, so they run inside
whole-stage codegen on the executors; no Python touches a row.

* ``whitespace`` (the Spark job's rule): split on runs of ASCII whitespace, keep
  case and punctuation.  Java's ``\\s`` includes the vertical tab and excludes
  NBSP / U+2003, which therefore stay inside a token.
* ``letters`` (the MapReduce job's rule): lower-case, then break on every
  character outside ``a-z``; digits, apostrophes and non-ASCII letters split.

A null line counts as the empty string, and empty tokens (leading separator,
trailing separator, empty line) are never counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = "whitespace"
LETTERS = "letters"
RULES = (WHITESPACE, LETTERS)

# The two split patterns that define the rules.
WHITESPACE_PATTERN = r"\s+"
LETTER_PATTERN = "[^a-z]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_split(text: str | Column, rule: str) -> Column:
    """Split without dropping blanks (the array may hold empty strings)."""
    t = F.coalesce(_col(text), F.lit(""))
    if rule == WHITESPACE:
        return F.split(t, WHITESPACE_PATTERN)
    if rule == LETTERS:
        return F.split(F.lower(t), LETTER_PATTERN)
    raise ValueError(f"unknown tokeniser rule {rule!r}; expected one of {RULES}")


def token_array(text: str | Column, rule: str) -> Column:
    """Array of the non-blank tokens of ``text``."""
    return F.filter(raw_split(text, rule), lambda w: w != "")


def token_count(text: str | Column, rule: str) -> Column:
    """Number of tokens in ``text`` without materialising a row per token."""
    return F.size(token_array(text, rule))


def tokens(df: DataFrame, text: str | Column = "value", rule: str = WHITESPACE,
           keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per token: ``(*keep, word)``.

    The explode runs on the raw split and the blank filter follows it, so the
    Generate and the Filter both stay in one codegen stage.
    """
    return (df.select(*keep, F.explode(raw_split(text, rule)).alias("word"))
              .where(F.col("word") != ""))


def register_sql(spark: SparkSession) -> None:
    """X1 + X2 for SQL users: the rules as functions ``letters(text)`` and
    ``whitespace_words(text)`` of the session, each the array of a text's tokens.

    They are SQL functions, which Catalyst inlines: ``SELECT word FROM (SELECT letters(text)
    AS words FROM t) LATERAL VIEW explode(words) AS word`` is a scan and a Generate, as
    :func:`tokens` is.  A function that returns a table reads shorter (``FROM t, LATERAL letters(text)``), but
    Catalyst joins its rows back by the text, with a shuffle of all texts; so there is none.
    """
    for name, split in (("letters", f"split(lower(coalesce(text, '')), '{LETTER_PATTERN}')"),
                        ("whitespace_words", f"split(coalesce(text, ''), r'{WHITESPACE_PATTERN}')")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS ARRAY<STRING> "
                  f"RETURN filter({split}, w -> w <> '')")
