"""A corpus pipeline over ``documents``: filter, deduplicate, pack.

STAGES lists (name, function).  Each function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``.  Each
stage's result is written as Parquet and read again as the next one's ``docs``.

Nulls, empty texts and repeated rows: see the operators' docstrings.  A document
with a null or letterless text is rejected by the language stage.
"""

from __future__ import annotations

from lexitally.llm import jaccard, langid, packing, rff, suffix
from lexitally.llm.common import discard, table, written

STAGES = [
    ("language_id", langid.stage),
    ("quality_classifier", rff.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("suffix_array_dedup", suffix.stage),
    ("best_fit_packing", packing.stage),
]

# Trained models and tokenisers have no SQL form; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply all stages to ``documents``, each on what its predecessor kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)                    # read for the last time
        before = docs
    return docs
