"""Cross-tokenizer alignment (operator 13).

Two tokenisers cut the same bytes.  The byte offsets at which a token of either
ends stand in an end-to-index dictionary for each; the intersection of their keys
holds the common ends.  Sorted, these cut both id lists into groups, and inside a
group every pair of tokens whose byte ranges overlap is a link.  The spans (below)
that are new to a task are aligned as one text, one after another; a full table of
spans keeps those that the texts at hand use again.

A (a rank file's byte-level vocabulary) runs over blank + text, B (a
SentencePiece model, which adds the blank itself) over the text.  Both end a
token before a blank that follows neither white space nor U+2581: A's pattern
takes a blank only at the start of a match or inside a run of white space, and
B's pieces have U+2581 only at their start.  So the text is aligned span by span
between such blanks, and a span that comes again is taken from a table.  A
vocabulary without that property makes the whole text one span.

How often an id pair is linked in the corpus is counted in two steps.  The
aligning pass packs documents into blocks of bounded text; a block's row holds
each distinct id pair once, with its number of links in the block, so a pair
that every document has reaches the shuffle once a block.  The sums go back to
the blocks that hold the pair, and each block adds up its documents.

Defined results: a text that is null or empty, or whose tokens of A or of B do
not join to the bytes of blank + text (a text with U+2581, for one), has no
tokens: zeros and an empty digest, and adds nothing to the counts.  Texts are
never cut; a document longer than a block is a block of its own.  Repeated rows
count each time.  A null doc_id is kept.  An empty table gives no rows.  Columns
of the input other than doc_id and text are not carried.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_cycle_search, written
from .piece import BLANK, SharedModel, groups

BLOCK_CHARS = 4 << 20      # text of a block; a longer document has a block of its own
SPANS = 1 << 18            # spans kept by a task; a fuller table goes on with those of the texts at hand
LONG = 64                  # longer spans are not kept

BLOCK_DDL = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
             "groups_sha256 string, spans binary, uses binary, "
             "pairs array<bigint>, linked array<bigint>, starts binary, members binary")
RESULT_DDL = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
              "count_sum bigint, groups_sha256 string")


# ---------------------------------------------------------------- spans
class Span(NamedTuple):
    """One aligned span: sizes, the groups' text, its links as packed pair numbers (a id above, b id below)."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    links: bytes


_SIZES = itemgetter(0, 1, 2, 3)
_GROUPS = itemgetter(4)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each common end of two cuts of the same bytes, in order: how many tokens of A and of B it closes."""
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1)))
    b_at = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return (np.fromiter(map(a_at.__getitem__, common), np.int64, len(common)),
            np.fromiter(map(b_at.__getitem__, common), np.int64, len(common)))


def expand_links(a_sizes: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links per token of A, and the links as (A index, B index): B's tokens from the one that holds
    a token's first byte to the one that holds its last.  They never pass a common end."""
    first, last = np.searchsorted(b_ends, a_ends - a_sizes, "right"), np.searchsorted(b_ends, a_ends, "left")
    n = last - first + 1
    return (n, np.repeat(np.arange(len(n)), n),
            np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))


class Aligner:
    """Both tokenisers and the bytes of their tokens."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes):
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.a_bytes = {i: token for token, i in merges.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        for i, token in self.a_bytes.items():
            self.a_sizes[i] = len(token)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.a_text, self.b_text = list(map(str, range(len(self.a_sizes)))), list(map(str, range(len(pieces))))
        self.blank = self.b.piece_to_id(BLANK)
        self.by_span = all(BLANK not in p.lstrip(BLANK) for p in pieces) and not self.b.is_unknown(self.blank)

    def spans(self, text: str) -> list[str]:
        """blank + text, cut before each blank that follows neither white space nor U+2581."""
        if not self.by_span or BLANK in text:
            return [" " + text]
        out, open_ = [], ""
        for word in text.split(" "):
            open_ += " " + word
            if word and not word[-1].isspace():
                out.append(open_)
                open_ = ""
        return out + [open_] if open_ else out

    def cut(self, spans: list[str]) -> list[Span | None]:
        """The spans aligned; None where the tokens of A or B do not join to the span's bytes."""
        a = [self.a.encode_ordinary(s) for s in spans]
        # the library gives nothing for a text without a character
        b = [ids or [self.blank] for ids in self.b.encode([s[1:] for s in spans], num_threads=1)]
        data = [s.encode("utf-8", "surrogatepass") for s in spans]
        if spans and self._joins(a, b, data):
            return self._align(a, b)
        fine = [b"".join(map(self.a_bytes.__getitem__, x)) == d == b"".join(map(self.b_bytes.__getitem__, y))
                for x, y, d in zip(a, b, data)]
        found = iter(self._align([x for x, ok in zip(a, fine) if ok], [y for y, ok in zip(b, fine) if ok]))
        return [next(found) if ok else None for ok in fine]

    def _joins(self, a: list[list[int]], b: list[list[int]], data: list[bytes]) -> bool:
        """Whether the tokens of every span join to its bytes: all of them together do, and each span has its length."""
        ends, whole = np.cumsum(np.fromiter(map(len, data), np.int64, len(data))), b"".join(data)
        for ids, sizes, token in ((a, self.a_sizes, self.a_bytes), (b, self.b_sizes, self.b_bytes)):
            stop = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            reached = np.cumsum(sizes[np.fromiter(itertools.chain.from_iterable(ids), np.int64)])[stop - 1]
            if (not np.array_equal(reached, ends)
                    or b"".join(map(token.__getitem__, itertools.chain.from_iterable(ids))) != whole):
                return False
        return True

    def _align(self, a: list[list[int]], b: list[list[int]]) -> list[Span]:
        """Spans one after another are one text of which every span's end is a common end."""
        if not a:
            return []
        a_ids, b_ids = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b))
        a_sizes = self.a_sizes[a_ids]
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(self.b_sizes[b_ids])
        a_cut, b_cut = common_ends(a_ends, b_ends)
        a_text = list(map(self.a_text.__getitem__, a_ids.tolist()))
        b_text = list(map(self.b_text.__getitem__, b_ids.tolist()))
        a_to, b_to = a_cut.tolist(), b_cut.tolist()
        groups = [f"{a_text[i]}|{b_text[k]}" if j - i == 1 == m - k else f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}"
                  for i, j, k, m in zip([0, *a_to], a_to, [0, *b_to], b_to)]
        n_links, left, right = expand_links(a_sizes, a_ends, b_ends)
        links = (a_ids[left] << 32 | b_ids[right]).tobytes()
        stop = np.cumsum(np.fromiter(map(len, a), np.int64, len(a)))
        group_stop = (np.searchsorted(a_cut, stop) + 1).tolist()
        link_stop = np.cumsum(n_links)[stop - 1].tolist()
        return [Span(len(x), len(y), g1 - g0, l1 - l0, ";".join(groups[g0:g1]).encode(), links[8 * l0:8 * l1])
                for x, y, g0, g1, l0, l1 in zip(a, b, [0, *group_stop], group_stop, [0, *link_stop], link_stop)]


@functools.lru_cache(maxsize=1)
def worker_aligner(ranks: bytes, pattern: str, model: bytes) -> Aligner:
    """The tokenisers of this Python worker; their size is bounded by the files'."""
    return Aligner(ranks, pattern, model)


def room(known: dict[str, Span | None], seen: set[str], more: int) -> dict[str, Span | None]:
    """The table of spans with room for ``more``: a full one goes on with the spans that are ``seen`` now."""
    return known if len(known) + more <= SPANS else {w: known[w] for w in seen & known.keys()}


# ---------------------------------------------------------------- blocks
class _Numbers(dict):
    """Number of each span in its block, given in order of first use."""

    def __init__(self):
        super().__init__()
        self.order: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.order.append(word)
        return number


class _Block:
    """Documents of one block, over the block's own numbers of spans and id pairs."""

    def __init__(self, ident: int):
        self.ident, self.chars = ident, 0
        self.number = _Numbers()
        self.spans: list[Span] = []
        self.docs: list[tuple] = []

    def add(self, doc_id, words: list[str], known: dict[str, Span | None], aligned: bool = True) -> None:
        """A document's spans; not ``aligned``: one of them has no tokens."""
        if not words or not aligned:
            self.docs.append((doc_id, "", b"", b""))
            return
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.spans.extend(map(known.__getitem__, self.number.order[len(self.spans):]))
        used, times = np.unique(numbers, return_counts=True)
        digest = hashlib.sha256(b";".join(map(_GROUPS, map(known.__getitem__, words)))).hexdigest()
        self.docs.append((doc_id, digest, np.diff(used, prepend=np.int32(0)).tobytes(), times.astype(np.int32).tobytes()))

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each document, the first with the block's tables of pairs and spans."""
        times = np.zeros(len(self.spans), dtype=np.int64)
        each = np.array(list(map(_SIZES, self.spans)), dtype=np.int64).reshape(-1, len(Span._fields) - 2)
        docs = []
        for doc_id, digest, used, counts in self.docs:
            at, n = np.cumsum(np.frombuffer(used, np.int32)), np.frombuffer(counts, np.int32)
            times[at] += n
            docs.append((doc_id, *(n.astype(np.int64) @ each[at]).tolist(), digest, used, counts))
        sizes = each[:, 3]
        links = np.frombuffer(b"".join([s.links for s in self.spans]), np.int64)
        pairs, members = np.unique(links, return_inverse=True)
        linked = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(linked, members, np.repeat(times, sizes))
        starts = np.cumsum(sizes) - sizes
        n = len(docs)
        first = lambda value: [value] + [None] * (n - 1)
        cols = [[self.ident] * n, *zip(*docs), first(pairs), first(linked),
                first(starts.astype(np.int32).tobytes()), first(members.astype(np.int32).tobytes())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def aligned(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """Documents in blocks: what each document has by itself, and the blocks' pairs and spans."""
    spark = docs.sparkSession
    ranks, model = SharedModel(spark, ranks_path).handle, SharedModel(spark, model_path).handle
    i64, i64s = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("block", i64), ("doc_id", i64), ("n_a", i64), ("n_b", i64), ("n_groups", i64),
                        ("n_links", i64), ("groups_sha256", pa.string()), ("spans", pa.binary()),
                        ("uses", pa.binary()), ("pairs", i64s), ("linked", i64s), ("starts", pa.binary()),
                        ("members", pa.binary())])

    def run(batches):
        tool = worker_aligner(ranks.value, pattern, model.value)
        known: dict[str, Span | None] = {}
        first = TaskContext.get().partitionId() << 32
        block = _Block(first)
        for rows in groups(batches, "doc_id", "text"):
            split = [tool.spans(text) if text else [] for _, text in rows]
            seen = set().union(*split)
            new = list(seen - known.keys())
            known = room(known, seen, len(new))
            known.update(zip(new, tool.cut(new)))
            bad = {w for w in seen if known[w] is None}
            for (doc_id, text), words in zip(rows, split):
                if block.docs and block.chars + len(text or "") > BLOCK_CHARS:
                    yield block.rows(schema)
                    block = _Block(block.ident + 1)
                block.add(doc_id, words, known, not bad or bad.isdisjoint(words))
                block.chars += len(text or "") + 16
            for w in new:
                if len(w) > LONG:
                    del known[w]
        if block.docs:
            yield block.rows(schema)

    def quietly(batches):
        with no_cycle_search():
            yield from run(batches)

    return docs.select("doc_id", "text").mapInArrow(quietly, BLOCK_DDL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n, best: links of each id pair in the corpus; best if no pair of its B id has more."""
    pair = (blocks.where("pairs is not null")
            .select(F.explode(F.arrays_zip("pairs", "linked")).alias("p"))
            .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.linked").alias("n")))
    pair = written(pair.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pair-counts")
    most = pair.groupBy("b").agg(F.max("n").alias("most"))
    return pair.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(docs: pa.Table, values: pa.Table) -> pa.Table:
    """Sums of one block's documents from the counts of its pairs."""
    n = len(docs)
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(values):
        head = next(r for r in range(n) if docs.column("starts")[r].as_py() is not None)
        starts = np.frombuffer(docs.column("starts")[head].as_py(), np.int32)
        members = np.frombuffer(docs.column("members")[head].as_py(), np.int32)
        count, top = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        place = values.column("place").to_numpy()
        count[place], top[place] = values.column("n").to_numpy(), values.column("best").cast(pa.int8()).to_numpy()
        by_span = np.add.reduceat(count[members], starts), np.add.reduceat(top[members], starts)
        for r in range(n):
            used = np.cumsum(np.frombuffer(docs.column("spans")[r].as_py(), np.int32))
            times = np.frombuffer(docs.column("uses")[r].as_py(), np.int32).astype(np.int64)
            total[r], best[r] = (by_span[0][used] * times).sum(), (by_span[1][used] * times).sum()
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column(
        "n_best", pa.array(best)).append_column("count_sum", pa.array(total)).append_column(
        "groups_sha256", docs.column("groups_sha256"))


def alignment(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    blocks = written(aligned(docs, ranks_path, pattern, model_path), "aligned", compression="zstd")
    wanted = (blocks.where("pairs is not null")
              .select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")))
    values = wanted.join(pair_counts(blocks), "pair").select("of", "place", "n", "best")
    return (blocks.drop("pairs", "linked").groupBy("block")
            .cogroup(values.groupBy("of")).applyInArrow(_scored, RESULT_DDL))


def links(text: str, ranks_path: str, pattern: str, model_path: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text as (A ids, B ids)."""
    with open(ranks_path, "rb") as r, open(model_path, "rb") as m:
        tool = worker_aligner(r.read(), pattern, m.read())
    found = tool.cut(tool.spans(text)) if text else []
    if None in found:
        return []
    split = [part.split("|") for s in found for part in s.groups.decode().split(";")]
    return [([int(x) for x in a.split(",")], [int(x) for x in b.split(",")]) for a, b in split]


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers as P
    return alignment(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
