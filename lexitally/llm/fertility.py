"""Quality rules by tokeniser fertility (operator 8).

Public vocabularies measure each whole text: characters per token, the share of
byte-fallback tokens, and the entropy of its tokens.  Rejection bands come from
the corpus itself: quartiles of each measure over all documents of a language
(or of a script, where the language is unknown) that pass the base rules, widened
by a multiple of their distance.  A document outside a band is rejected.  A group
of few documents has its own quartiles too; its band's reach goes from that of all
documents to its own as the group grows, by one formula without a step, and is the
wider the smaller the group: a rare language is never held against the majority's band.

Tokens are counted word by word with one table per task, so cost follows the
number of distinct words of a text.

Defined results: a null text has no words and fails the base rules; texts of
unknown language without a letter are a group of their own; an empty table gives no rows; repeated rows count as often as they occur.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SharedVocabulary
from .common import Chunks, ascii_words, no_cycle_search, worker_object, written
from .packing import worker_encoder
from .piece import groups

SYMBOLS = re.compile(r"[#*$%&|<>]")
CACHE_WORDS = 1 << 18
SURE = 30                       # passing documents at which a group's own quartiles count as much as the corpus's
FENCE = 3.0                     # band: quartiles +- FENCE * (distance of the quartiles)
STEADY_WORDS = 150              # measures of shorter texts spread more: bands widen by sqrt(1 + this / n_words)
SLACK = {"chars_per_token": 0.1, "byte_share": 0.02, "token_entropy": 0.03}
MEASURES = tuple(SLACK)


def repeated_window_words(ids: np.ndarray, n: int = 3) -> int:
    """Words inside a window of ``n`` words that occurs twice or more in the text."""
    if len(ids) < n:
        return 0
    width = int(ids.max()) + 1
    key = ids[:-2].astype(np.int64) * width + ids[1:-1]
    if width < 1 << 20:                               # three ids fit into 62 bits
        key = key * width + ids[2:]
    else:
        _, pair = np.unique(key, return_inverse=True)
        key = pair.astype(np.int64) * width + ids[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = count[back] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(n):
        covered[i:len(ids) - n + 1 + i] |= starts
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = ascii_words(text)
    order: dict[bytes, int] = {}
    ids = np.fromiter((order.setdefault(w, len(order)) for w in words), np.int64, len(words))
    # code points of the words: those of the text less its white space
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), len(text) - blanks, sum(map(text.count, "#*$%&|<>")),
            len(lines) - len(set(lines)), repeated_window_words(ids))


def script_of(text: str | None) -> str:
    """Script of most letters among the distinct letters, by their Unicode names."""
    seen = Counter()
    for ch, n in Counter(text or "").items():
        if ch.isalpha():
            seen["LATIN" if ch.isascii() else unicodedata.name(ch, "OTHER").split(" ")[0]] += n
    return min(seen, key=lambda s: (-seen[s], s)).lower() if seen else "none"


class Meter:
    """Fertility measures of texts with the two vocabularies.

    Keeps a bounded table: word -> (packed ids, number of ids, byte-fallback tokens, pieces).
    """

    def __init__(self, bpe, pieces):
        self.bpe, self.pieces = bpe, pieces
        self.is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        self.words: dict[str, tuple[bytes, int, int, int]] = {}

    def learn(self, words: list[str]) -> None:
        """Encode words new to the table, each vocabulary in one go."""
        if not words:
            return
        pieces = self.pieces.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.is_byte[np.fromiter(itertools.chain.from_iterable(pieces), np.int64, int(sizes.sum()))]
        done = np.concatenate([[0], np.cumsum(flat)])
        stop = np.cumsum(sizes)
        fallback = (done[stop] - done[stop - sizes]).tolist()
        for word, n, byte in zip(words, sizes.tolist(), fallback):
            packed = self.bpe.encode_packed(" " + word)
            self.words[word] = packed, len(packed) // 4, byte, n

    def measure_all(self, texts: list[str | None]) -> list[tuple[float, float, float]]:
        """(characters per token, byte-fallback share, entropy of the tokens) of each text.

        The entropy is a share of the largest one that so many tokens can have.
        All are 0 for a text without words.
        """
        counts = [Counter((t or "").split()) for t in texts]
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.learn(list(set().union(*counts) - self.words.keys()))
        return [self._measure(c) for c in counts]

    def measure(self, text: str | None) -> tuple[float, float, float]:
        return self.measure_all([text])[0]

    def _measure(self, counts: Counter) -> tuple[float, float, float]:
        if not counts:
            return 0.0, 0.0, 0.0
        packed, sizes, fallback, pieces = zip(*map(self.words.__getitem__, counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        ids, sizes = np.frombuffer(b"".join(packed), "<u4"), np.array(sizes)
        total = int(n @ sizes)
        chars = sum(map(mul, map(len, counts), counts.values()))
        _, back = np.unique(ids, return_inverse=True)
        p = np.bincount(back, np.repeat(n, sizes)) / total
        entropy = float(-(p * np.log2(p)).sum()) / math.log2(total) if total > 1 else 1.0
        return chars / max(1, total), int(n @ np.array(fallback)) / max(1, int(n @ np.array(pieces))), entropy


def _worker_pieces(shared):
    import sentencepiece
    return worker_object("fertility", "pieces", shared.id,
                         lambda: sentencepiece.SentencePieceProcessor(model_proto=shared.value))


class _SharedBytes(SharedVocabulary):
    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            data = f.read(self.MAX_BYTES + 1)
        if len(data) > self.MAX_BYTES:
            raise ValueError(f"{path} is too large for a vocabulary file")
        self.handle = spark.sparkContext.broadcast(data)
        self.id = self.handle._jbroadcast.id()


def measures(docs: DataFrame, bpe_path: str, pieces_path: str) -> DataFrame:
    """Base counts, fertility measures and group of every whole text (doc_id, text, lang)."""
    spark = docs.sparkSession
    bpe, pieces = SharedVocabulary(spark, bpe_path), _SharedBytes(spark, pieces_path)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in names]
                       + [(m, pa.float64()) for m in MEASURES] + [("band_group", pa.string())])

    def run(batches):
        meter, out = Meter(worker_encoder(bpe, "fertility"), _worker_pieces(pieces)), Chunks(schema)
        for rows in groups(batches, "doc_id", "lang", "text"):
            for (doc, lang, text), found in zip(rows, meter.measure_all([r[-1] for r in rows])):
                group = f"language {lang}" if lang is not None else f"script {script_of(text)}"
                yield from out.add((doc, *base_counts(text), *found, group), 150)
        yield from out.rest()

    ddl = ", ".join(["doc_id bigint"] + [f"{n} bigint" for n in names]
                    + [f"{m} double" for m in MEASURES] + ["band_group string"])
    def quietly(batches):
        with no_cycle_search():
            yield from run(batches)

    return docs.select("doc_id", "text", "lang").mapInArrow(quietly, ddl)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """One row per group: quartiles of each measure and how far the band reaches beyond them.

    Quartiles are mergeable sketches over all passing documents, so a group of
    any size is aggregated before the shuffle.
    """
    passing = measured.where(~base_failed())
    tagged = passing.select("band_group", *MEASURES)
    quart = [F.percentile_approx(m, [0.25, 0.75], 2000).alias(m) for m in MEASURES]
    own = tagged.groupBy("band_group").agg(F.count("*").alias("n"), *quart)
    whole = tagged.agg(F.count("*").alias("n"), *quart).select(
        F.lit(None).cast("string").alias("band_group"), "n", *MEASURES)
    out = own.unionByName(whole)
    for m in MEASURES:
        reach = F.greatest(FENCE * (F.col(m)[1] - F.col(m)[0]), F.lit(SLACK[m]))
        out = out.withColumn(m, F.struct(F.col(m)[0].alias("low"), F.col(m)[1].alias("high"), reach.alias("reach")))
    return out


def judge(measured: DataFrame) -> DataFrame:
    """Adds base_failed, inside (the bands) and kept; ``measured`` must be a written table."""
    all_bands = written(bands(measured), "bands")
    # the single row over all documents becomes constants of the plan
    whole = all_bands.where("band_group is null").first()
    own = all_bands.where("band_group is not null").select(
        F.col("band_group"), F.col("n").alias("_n"), *[F.col(m).alias(f"_{m}") for m in MEASURES])
    joined = measured.join(own, "band_group", "left")
    inside = F.lit(True)
    # one formula for every size: the reach goes from the corpus's to the group's own as the group
    # grows, and is wider the less sure its quartiles are
    trust = F.col("_n") / (F.col("_n") + SURE)
    spread = F.sqrt(1 + SURE / F.col("_n"))
    wider = F.sqrt(1 + STEADY_WORDS / F.greatest("n_words", F.lit(1)))
    for m in MEASURES:
        default = whole[m] if whole else None

        def part(name):
            fixed = default[name] if default else None
            return F.coalesce(F.col(f"_{m}")[name], F.lit(fixed).cast("double"))
        least = F.lit(default["reach"] if default else None).cast("double")
        mixed = trust * part("reach") + (1 - trust) * F.greatest(part("reach"), least)
        reach = F.coalesce(mixed * spread, least) * wider
        outside = (F.col(m) < part("low") - reach) | (F.col(m) > part("high") + reach)
        inside = inside & ~F.coalesce(outside, F.lit(False))
    return joined.select(*measured.columns, base_failed().alias("base_failed"), inside.alias("inside"),
                         (~base_failed() & inside).alias("kept"))


def rules(docs: DataFrame, bpe_path: str, pieces_path: str) -> DataFrame:
    return judge(written(measures(docs, bpe_path, pieces_path), "fertility"))


def query(spark, docs: DataFrame) -> DataFrame:
    import public_tokenizers as P
    return rules(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
