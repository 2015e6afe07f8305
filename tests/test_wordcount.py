"""Word-count invariants on the documents table."""

from pyspark.sql import functions as F

from lexitally.functions.tokenize import LETTERS, WHITESPACE
from lexitally.operators import wordcount as W
from lexitally.sources.tables import read_table
from lexitally.sources.text import read_lines
from conftest import SF_SMALL, SF_SMOKE


def test_totals_match_survey_counts(spark):
    docs = read_table(spark, SF_SMALL, "documents", ["text"])
    assert W.word_total(docs, "text", WHITESPACE).first().word_count == 390171
    freq = W.word_freq(docs, "text", LETTERS)
    assert freq.count() == 53962
    assert freq.agg(F.sum("n")).first()[0] == 401563


def test_sum_of_frequencies_is_total(spark):
    docs = read_table(spark, SF_SMOKE, "documents", ["lang", "text"])
    for rule in (WHITESPACE, LETTERS):
        total = W.word_total(docs, "text", rule).first().word_count
        assert W.word_freq(docs, "text", rule).agg(F.sum("n")).first()[0] == total
        per_ds = W.dataset_words(docs, "lang", "text", rule).agg(F.sum("total_words")).first()[0]
        assert per_ds == total


def test_unchanged_under_repartition(spark):
    docs = read_table(spark, SF_SMOKE, "documents", ["text"])
    a = sorted(W.word_freq(docs, "text", LETTERS).collect())
    b = sorted(W.word_freq(docs.repartition(13), "text", LETTERS).collect())
    assert a == b


def test_text_round_trip(spark, tmp):
    """documents.text written as text files and re-scanned gives the same counts."""
    docs = read_table(spark, SF_SMOKE, "documents", ["text"])
    docs.select(F.col("text").alias("value")).write.text(tmp + "/ds")
    lines = read_lines(spark, tmp + "/ds")
    for rule in (WHITESPACE, LETTERS):
        a = sorted(W.word_freq(docs, "text", rule).collect())
        b = sorted(W.word_freq(lines, "value", rule).collect())
        assert a == b


def test_dataset_bytes_and_facts(spark):
    docs = read_table(spark, SF_SMOKE, "documents", ["lang", "text"])
    by = {r.dataset: r for r in W.dataset_bytes(docs, "lang", "text").collect()}
    facts = {r.dataset: r for r in W.dataset_facts(docs, "lang", "text").collect()}
    assert set(by) == set(facts)
    for k in by:
        assert by[k].dataset_bytes == facts[k].dataset_bytes
    raw = sum(len(r.text.encode("utf-8")) for r in docs.collect())
    assert sum(r.dataset_bytes for r in by.values()) == raw


def test_reducer_layout_is_sorted_and_disjoint(spark):
    docs = read_table(spark, SF_SMOKE, "documents", ["text"])
    laid = W.reducer_sorted(W.word_freq(docs, "text", LETTERS))
    parts = laid.rdd.glom().collect()  # test-only inspection of the layout
    seen = set()
    for p in parts:
        words = [r.word for r in p]
        assert words == sorted(words)
        assert not (seen & set(words))
        seen |= set(words)
    assert len(seen) == W.word_freq(docs, "text", LETTERS).count()
