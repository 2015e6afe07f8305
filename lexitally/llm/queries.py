"""Registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, ann, bpe, fertility, htmltext, jaccard, langid, lexical, packing, piece, rff, suffix, warc
from .common import table


def op1_bpe(spark, d):
    """Ids of every document with a word-end BPE vocabulary, and the text decoded from them."""
    import public_tokenizers as P
    coded = bpe.bpe_encode(table(spark, d, "documents", "doc_id", "text"), P.path("word_bpe_49k.json"),
                           keep=("doc_id",), decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_suffix_dedup(spark, d):
    """Every document without the bytes of 400-byte strings that start anywhere else."""
    return suffix.query(spark, table(spark, d, "documents", "doc_id", "text"))


def op3_html_extraction(spark, d):
    """Main text of every page."""
    return htmltext.extract(table(spark, d, "pages", "page_id", "url", "html"))


def op4_language_id(spark, d):
    """Language of every document, learned from the documents that are not held out."""
    return langid.query(spark, table(spark, d, "documents", "doc_id", "text", "lang"))


def op5_jaccard_join(spark, d):
    """Components of documents whose 5-word shingles have a similarity of 0.8 or more."""
    return jaccard.query(spark, table(spark, d, "documents", "doc_id", "text"))


def op6_best_fit_packing(spark, d):
    """Pieces of every document, packed into sequences of at most 2048 tokens."""
    return packing.query(spark, table(spark, d, "documents", "doc_id", "text"))


def op7_warc_revisits(spark, d):
    """Pages written as WARC archives with revisit records, and read back."""
    found = warc.round_trip(table(spark, d, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_fertility_rules(spark, d):
    """Base rules and fertility bands for every document."""
    return fertility.query(spark, table(spark, d, "documents", "doc_id", "text", "lang"))


def op9_block_matrix_neighbours(spark, d):
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, d, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op10_quality_classifier(spark, d):
    """Quality score of every document, learned from labels that are not held out."""
    return rff.query(spark, table(spark, d, "documents", "doc_id", "text"),
                     table(spark, d, "labels", "doc_id", "quality"))


def op11_lexical_search(spark, d):
    """The 10 highest-scoring documents of every benchmark item."""
    return lexical.query(spark, table(spark, d, "documents", "doc_id", "text"),
                         table(spark, d, "benchmark", "item_id", "text"))


def op12_sentencepiece(spark, d):
    """Ids of every document with a merge-type SentencePiece vocabulary, and the text decoded from them."""
    import public_tokenizers as P
    coded = piece.encode(table(spark, d, "documents", "doc_id", "text"), P.path("piece_bpe_32k.model"),
                         keep=("doc_id",), decode=True, check=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")


def op13_cross_alignment(spark, d):
    """Every document's tokens of two vocabularies in groups between common ends, with corpus-wide link counts."""
    return align.query(spark, table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_suffix_dedup, op3_html_extraction, op4_language_id, op5_jaccard_join, op6_best_fit_packing, op7_warc_revisits, op8_fertility_rules,
    op9_block_matrix_neighbours, op10_quality_classifier, op11_lexical_search, op12_sentencepiece, op13_cross_alignment)}
ORACLE: dict[str, str] = {"op2_suffix_dedup": suffix.SQL, "op5_jaccard_join": jaccard.SQL, "op7_warc_revisits": warc.SQL, "op9_block_matrix_neighbours": ann.SQL,
                         "op11_lexical_search": lexical.SQL}
