"""Best-fit packing of token sequences by exact complements (operator 6).

The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus holds.  Longest first, each length's
gap ``capacity - length`` is looked up in an index of sums of one, two and
three available lengths; a combination that fills the gap exactly is consumed
as often as its lengths last.  What finds no exact complement is best-fit: the
largest lengths that still fit the gap are added until none does.  Each step
uses up a length, so the plan has a few thousand patterns at most.

Spark then deals the pieces to the plan: pieces of one length are
interchangeable, so the n-th piece of a length takes the n-th place that the
plan has for it.  The numbers come from counts by (length, salt) and a running
number inside each salt, so that a length which a third of all pieces share is
numbered by many tasks.

Defined results: a null text is empty and still yields its end-of-text piece;
only documents longer than ``capacity`` are cut (first piece: the remainder);
repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import BYTE_LEVEL_PATTERN, Bpe, SharedVocabulary, byte_symbols
from .common import Chunks, frugal, rows_of, worker_object, written

PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Packed ids of whole texts by a public tokeniser file.

    A byte-level vocabulary whose ids follow the order of its merges is run by
    the ``tiktoken`` library on ranks read from the same file, which gives the
    same ids several times faster; any other file is run by :class:`Bpe`.
    """

    def __init__(self, source: str):
        self.bpe = Bpe(source)
        self.fast = None
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        ordered = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(
            m if isinstance(m, list) else m.split(" ") for m in merges))
        if ordered and not self.bpe.suffix and not self.bpe.steps and spec["pre_tokenizer"]["type"] == "ByteLevel":
            back = {c: b for b, c in enumerate(byte_symbols())}
            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if i not in self.bpe.added.values()}
            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bpe.drop_tables()             # only the added tokens are still asked for

    def encode_packed(self, text: str | None) -> bytes:
        if self.fast is None:
            return self.bpe.encode_packed(text)
        out = array("I")
        for part, special in self.bpe.segments(text or ""):
            out.extend(self.fast.encode_ordinary(part))
            if special >= 0:
                out.append(special)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


def worker_encoder(shared, owner: str = "packing") -> Encoder:
    """The encoder of this Python worker, built once per broadcast."""
    return worker_object(owner, "encoder", shared.id, lambda: Encoder(shared.value))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int | None = 0,
                 with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those of more than ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32 (and ``ids``, packed).  The
    first piece of a cut document is the remainder, the others are full.
    """
    shared = SharedVocabulary(docs.sparkSession, vocabulary)
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())]
                       + ([("ids", pa.binary())] if with_ids else []))

    def cut(batches):
        encoder, out = worker_encoder(shared), Chunks(schema)
        for batch in batches:
            for doc, text in rows_of(batch, "doc_id", "text"):
                packed = encoder.encode_packed(text) + tail
                total, start, piece = len(packed) // 4, 0, 0
                while start < total:
                    length = (total % capacity or capacity) if start == 0 else capacity
                    ids = packed[4 * start:4 * (start + length)]
                    row = (doc, piece, start, length, zlib.crc32(ids))
                    yield from out.add(row + ((ids,) if with_ids else ()), 40 + len(ids) * with_ids)
                    start, piece = start + length, piece + 1
        yield from out.rest()

    return docs.select("doc_id", "text").mapInArrow(frugal(cut), PIECE_DDL + (", ids binary" if with_ids else ""))


# ---------------------------------------------------------------- the plan
class _Sums:
    """Index of sums of one, two and three available lengths."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.n, self.capacity = counts, capacity

    def _ok(self, used: list[int]) -> bool:
        return all(self.n[x] >= used.count(x) for x in set(used))

    def pair(self, total: int, taken: list[int]) -> list[int] | None:
        """Two available lengths of this sum, the larger as large as possible."""
        if total < 2:
            return None
        low = np.arange(1, total // 2 + 1)
        for a in low[(self.n[low] > 0) & (self.n[total - low] > 0)]:
            if self._ok(taken + [total - int(a), int(a)]):
                return [total - int(a), int(a)]
        return None

    def exact(self, gap: int, taken: list[int]) -> list[int] | None:
        """One, two or three available lengths that fill ``gap`` exactly."""
        if self.n[gap] and self._ok(taken + [gap]):
            return [gap]
        if found := self.pair(gap, taken):
            return found
        # a triple: its largest part is at least a third of the gap
        for big in range(gap - 2, (gap - 1) // 3, -1):
            if self.n[big] and self._ok(taken + [big]):
                rest = self.pair(gap - big, taken + [big])
                if rest:
                    return [big, *rest]
        return None


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of each pattern; every piece is placed exactly once.

    Works on counts alone, so its cost depends on ``capacity`` only.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        n[length] += count
    sums, patterns = _Sums(n, capacity), []

    def use(lengths: list[int]):
        times = min(int(n[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            n[x] -= times
        patterns.append((times, lengths))

    if n[capacity]:
        use([capacity])
    left: list[int] = []
    for length in range(capacity - 1, 0, -1):
        while n[length]:
            more = sums.exact(capacity - length, [length])
            if more is None:
                break
            use([length, *more])
    # best fit of what no exact complement took
    left = [x for x in range(1, capacity + 1) if n[x]]
    while left:
        row = [left[-1]]
        gap, used = capacity - row[0], {row[0]: 1}
        while gap:
            i = bisect.bisect_right(left, gap) - 1
            while i >= 0 and n[left[i]] <= used.get(left[i], 0):
                i -= 1
            if i < 0:
                break
            x = left[i]
            fit = min(gap // x, int(n[x]) - used.get(x, 0))
            row += [x] * fit
            used[x] = used.get(x, 0) + fit
            gap -= fit * x
        use(row)
        left = [x for x in left if n[x]]
    return patterns


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple]:
    """Rows (length, first_rank, last_rank, first_sequence, offset, copies).

    Pieces of ``length`` numbered first_rank..last_rank go to the sequences of
    one pattern, ``copies`` of them to each, one after another from ``offset``.
    """
    rows, taken, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        for x in dict.fromkeys(lengths):
            copies = lengths.count(x)
            first = taken.get(x, 0)
            taken[x] = first + times * copies
            rows.append((x, first, taken[x] - 1, sequence, offset, copies))
            offset += copies * x
        sequence += times
    return rows


# ------------------------------------------------------------ dealing out
def pack(pieces: DataFrame, capacity: int, salts: int = 256) -> DataFrame:
    """Give each row of ``pieces`` (column ``length``) a sequence_id and offset.

    ``pieces`` must be stable when read again (a written table).  Two small
    aggregates go to the driver: the histogram by (length, salt), which has at
    most capacity * salts entries, is the larger one and stays in Spark.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # full pieces need no numbering: each is a sequence of its own
    short = salted.where(F.col("length") < capacity)
    counts = written(short.groupBy("length", "_salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in                                   # <= capacity rows
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = places(plan_patterns(histogram, capacity))
    plan = spark.createDataFrame(
        rows, "_length bigint, _first bigint, _last bigint, _seq bigint, _at bigint, _copies bigint")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = (short.withColumn("_n", F.row_number().over(inside) - 1)
              .join(bases, ["length", "_salt"])
              .withColumn("_rank", F.col("_n") + F.col("_base")))
    # the plan has a few thousand rows at most (see module docstring): broadcast
    dealt = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length"))
                        & F.col("_rank").between(F.col("_first"), F.col("_last")))
    k = F.col("_rank") - F.col("_first")
    dealt = (dealt.withColumn("sequence_id", F.col("_seq") + F.floor(k / F.col("_copies")).cast("bigint"))
             .withColumn("offset", F.col("_at") + F.pmod(k, F.col("_copies")) * F.col("length")))
    # sequence numbers of full pieces are negative, from their place in the table
    full = (salted.where(F.col("length") >= capacity)
            .withColumn("sequence_id", -1 - F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("bigint")))
    cols = [*pieces.columns, "sequence_id", "offset"]
    return dealt.select(*cols).unionByName(full.select(*cols))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """Tokenise, cut and pack whole documents (see the module's defined results)."""
    return pack(written(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order, and its fill."""
    part = F.struct("offset", "doc_id", "piece", "start", "length")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"),
                                             F.array_sort(F.collect_list(part)).alias("parts"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return query(spark, docs)
