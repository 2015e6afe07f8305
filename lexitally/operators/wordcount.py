"""Word counting: global totals, per-word frequencies, per-dataset totals.

Scale notes
-----------
* Totals never explode: each line contributes ``size(tokens)`` to a partial
  sum, so a 100 TB corpus produces one long per task before the single-row
  final aggregate.
* Per-word counts aggregate partially before the shuffle (map-side combine),
  so a word holding a third of all tokens ships one row per map task, not a
  third of the data.  The final aggregate is hash-partitioned on ``word`` and
  AQE coalesces the reducers to the real output size.
* Counts are ``bigint``; a 32-bit reducer sum would wrap past 2^31-1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.tokenize import LETTERS, WHITESPACE, token_count, tokens


def word_total(lines: DataFrame, text: str | Column = "value",
               rule: str = WHITESPACE) -> DataFrame:
    """One row, ``word_count``: the number of tokens in all lines."""
    return lines.agg(
        F.coalesce(F.sum(token_count(text, rule)), F.lit(0)).cast("bigint")
        .alias("word_count"))


def word_freq(lines: DataFrame, text: str | Column = "value",
              rule: str = LETTERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, word, n)``: how often each token occurs."""
    return (tokens(lines, text, rule, keep)
            .groupBy(*keep, "word")
            .agg(F.count(F.lit(1)).alias("n")))


def dataset_words(df: DataFrame, dataset: str = "dataset",
                  text: str | Column = "value", rule: str = LETTERS) -> DataFrame:
    """``(dataset, total_words)`` without exploding a row per token."""
    return (df.groupBy(F.col(dataset).alias("dataset"))
              .agg(F.sum(token_count(text, rule)).cast("bigint").alias("total_words")))


def dataset_bytes(df: DataFrame, dataset: str = "dataset",
                  text: str | Column = "value") -> DataFrame:
    """``(dataset, n_rows, dataset_bytes)``: UTF-8 bytes of the text column."""
    t = F.col(text) if isinstance(text, str) else text
    return (df.groupBy(F.col(dataset).alias("dataset"))
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).cast("bigint")
                   .alias("dataset_bytes")))


def dataset_facts(df: DataFrame, dataset: str = "dataset",
                  text: str | Column = "value", rule: str = WHITESPACE) -> DataFrame:
    """``(dataset, word_count, dataset_bytes)`` in one pass over the text."""
    t = F.col(text) if isinstance(text, str) else text
    return (df.groupBy(F.col(dataset).alias("dataset"))
              .agg(F.sum(token_count(t, rule)).cast("bigint").alias("word_count"),
                   F.sum(F.octet_length(t)).cast("bigint").alias("dataset_bytes")))


def observed(lines: DataFrame, facts: Observation, text: str | Column = "value", rule: str = LETTERS) -> DataFrame:
    """A9 + M1 + M2: ``lines``, with rows, words and UTF-8 bytes counted as they pass.

    The counts are there once an action over the result has run (``facts.get``): the scan
    that writes a job's files gives its throughput facts, too.
    """
    t = F.col(text) if isinstance(text, str) else text
    return lines.observe(facts, F.count(F.lit(1)).alias("n_rows"),
                         F.coalesce(F.sum(token_count(t, rule)), F.lit(0)).cast("bigint").alias("n_words"),
                         F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).cast("bigint").alias("n_bytes"))


def reducer_sorted(freq: DataFrame, key: str = "word") -> DataFrame:
    """Reducer layout: the aggregate's own hash partitions on ``key``, each sorted.

    No exchange of its own; the number of reducers is the job's shuffle width,
    which AQE fits to the output.
    """
    return freq.sortWithinPartitions(key)


def kv_lines(freq: DataFrame, key: str = "word", value: str = "n") -> DataFrame:
    """``key<TAB>count`` text lines, one column ``line``."""
    return freq.select(F.concat_ws("\t", F.col(key), F.col(value).cast("string"))
                       .alias("line"))
