"""Ranked lexical search over a length-stratified index (operator 11).

The index holds documents in blocks of bounded text: a block's own sorted terms,
and for each term its documents and how often they hold it.  A block is kept as
rows of bounded size, each with some of its terms (the first with its documents'
ids), in row groups of few rows: what reads, sorts or deals them holds little at
once, however much one task reads.  The normaliser m of
a document depends on its length and on two sums over the corpus, so documents of
one block with equal m form a stratum.  Within a stratum a term's postings stand
by tf: the impact of (m, tf) is computed once for all documents that share both.

A search holds blocks of queries against blocks of documents.  For one query a
stratum's bound is the sum of its terms' weights times their largest impacts
there.  Strata are visited from the highest bound down, a few and then twice as
many at a time, and the search of a block ends when the next bound is below the
k-th best score so far; what was found in one block carries over to the next.
Each task gives its k best of each query, and Spark takes the k best of those.

Terms are the maximal runs of ASCII letters and digits and of all characters
beyond ASCII, A-Z lower-cased.  A term's weight is floor(1000 ln((2N+2)/(2df+1)))
in doubles; everything else is done in whole numbers.

Defined results: a null or empty text, or one without a term, is no document and
never found; a query without a term that the corpus holds has no rows; equal
scores go by ascending doc_id, a null doc_id last; repeated rows are documents of
their own; repeated queries (same id and text) are one query, queries that share
an id but not a text are ranked apart.  Texts are never cut: a document longer
than a block is a block of its own.  Empty tables give no rows.  Columns other
than doc_id and text (item_id and text) are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frugal, rows_of, trim_memory, written

BLOCK_BYTES = 4 << 20      # text of an index block; a longer document has a block of its own
DOC_BYTES = 64             # what a document adds to that beside its text
ROW_BYTES = 256 << 10      # terms and postings of an index row; a longer term's postings have a row of their own
GROUP_ROWS = 16            # rows of a row group of the written index: a reader holds no more at once
CELL_BYTES = 8 << 20       # index text that a search holds at once, about
QUERY_TERMS = 1 << 16      # terms of the queries that a search holds at once, about
FIRST_DOCS = 64            # documents of the first strata to be visited

# Fixed value: what a term is made of, once A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values of the score.
SCALE, TF_UNIT, LENGTH_UNIT, FLAT, SLOPE = 1_000_000_000, 1000, 8, 25, 75

# UTF-8 bytes: what no term holds becomes a blank, A-Z lower-case; bytes beyond ASCII stay.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX_DDL = ("block bigint, part bigint, n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, "
             "terms array<string>, dfs array<bigint>, docs binary, tfs binary")
_NULL_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


# ---------------------------------------------------------------- the index
class _Block:
    def __init__(self, ident: int):
        self.ident, self.size = ident, 0
        self.ids, self.lengths = [], []
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}

    def add(self, doc_id, counts: Counter) -> None:
        number = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        get = self.postings.get
        for term, tf in counts.items():
            found = get(term)
            if found is None:
                found = self.postings[term] = ([], [])
            found[0].append(number)
            found[1].append(tf)

    def rows(self, schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
        """The terms in order, as many a row as ``limit`` bytes hold; the documents stand in the first row."""
        some, size, part = [], 0, 0
        for term in sorted(self.postings):
            more = len(term) + 16 + 8 * len(self.postings[term][0])
            if some and size + more > limit:
                yield self._row(schema, part, some)
                some, size, part = [], 0, part + 1
            some.append(term)
            size += more
        yield self._row(schema, part, some)

    def _row(self, schema: pa.Schema, part: int, terms: list[bytes]) -> pa.RecordBatch:
        docs = np.array([d for t in terms for d in self.postings[t][0]], dtype="<i4")
        tfs = np.array([x for t in terms for x in self.postings[t][1]], dtype="<i4")
        ids, lengths = ([], []) if part else (self.ids, self.lengths)
        values = [self.ident, part, len(ids), sum(lengths), ids, lengths,
                  [t.decode("utf-8", "replace") for t in terms], [len(self.postings[t][0]) for t in terms],
                  docs.tobytes(), tfs.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of every document with a term, some rows a block (written below the shared folder)."""
    i64 = pa.int64()
    schema = pa.schema([("block", i64), ("part", i64), ("n_docs", i64), ("n_terms", i64), ("ids", pa.list_(i64)),
                        ("lengths", pa.list_(i64)), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(i64)),
                        ("docs", pa.binary()), ("tfs", pa.binary())])

    def run(batches):
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                counts = Counter(terms_of(text))
                if not counts:
                    continue
                size = len(text) + DOC_BYTES
                if block.ids and block.size + size > BLOCK_BYTES:
                    yield from block.rows(schema, ROW_BYTES)
                    block = _Block(block.ident + 1)
                block.add(doc_id, counts)
                block.size += size
        if block.ids:
            yield from block.rows(schema, ROW_BYTES)

    return written(docs.select("doc_id", "text").mapInArrow(frugal(run), INDEX_DDL), "lexical-index",
                   **{"parquet.block.row.count.limit": GROUP_ROWS, "parquet.enable.dictionary": False})


def query_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term, q: how often a query holds each of its terms."""
    lowered = F.translate("text", UPPER, LOWER)
    return (items.where("text is not null")
            .select("item_id", F.sha2("text", 256).alias("_text"), lowered.alias("text")).dropDuplicates(["item_id", "_text"])
            .select("item_id", F.struct("item_id", "_text").alias("item"),
                    F.explode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("term"))
            .groupBy("item", "item_id", "term").agg(F.count("*").alias("q")))


def weighted_terms(index: DataFrame, items: DataFrame) -> DataFrame:
    """item, item_id, term, weight: weight times repeats of the query terms that the corpus holds."""
    asked = query_terms(items)
    held = (index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p"))
            .select(F.col("p.terms").alias("term"), F.col("p.dfs").alias("df"))
            .join(asked.select("term").distinct(), "term", "left_semi")
            .groupBy("term").agg(F.sum("df").alias("df")))
    n = index.agg(F.sum("n_docs")).first()[0] or 0
    weight = F.floor(1000.0 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return (asked.join(held.select("term", weight.cast("bigint").alias("w")), "term")
            .select("item", "item_id", "term", (F.col("w") * F.col("q")).alias("weight")))


# ---------------------------------------------------------------- the search
class Stratified:
    """One index block by strata: segments of postings that share term and m, in order of tf."""

    def __init__(self, ids, lengths, terms, dfs, docs, tfs, n_docs: int, n_terms: int):
        lengths = np.asarray(lengths, dtype=np.int64)
        # by Python's whole numbers: n * N may pass 64 bits
        by_length = {n: FLAT + SLOPE * n * n_docs // n_terms for n in np.unique(lengths).tolist()}
        m = np.array([by_length[n] for n in lengths.tolist()], dtype=np.int64)
        self.m, stratum = np.unique(m, return_inverse=True)
        self.docs_in = np.bincount(stratum, minlength=len(self.m))
        self.ids = np.array([_NULL_ID if i is None else i for i in ids], dtype=np.int64)
        self.null = np.array([i is None for i in ids])
        self.number = {t: i for i, t in enumerate(terms)}
        term = np.repeat(np.arange(len(terms)), dfs)
        docs, tfs = docs.astype(np.int64), tfs.astype(np.int64)
        order = np.lexsort((tfs, stratum[docs], term))
        self.docs, tfs, term = docs[order], tfs[order], term[order]
        of = stratum[self.docs]
        new_group = np.ones(len(term), dtype=bool)         # postings that share term, m and tf
        new_group[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1]) | (tfs[1:] != tfs[:-1])
        head = np.flatnonzero(new_group)
        impact = (SCALE * tfs[head]) // (TF_UNIT * tfs[head] + LENGTH_UNIT * self.m[of[head]])
        self.impact = impact[np.cumsum(new_group) - 1]
        new_seg = np.ones(len(term), dtype=bool)           # segments: term and m
        new_seg[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        self.start = np.flatnonzero(new_seg)
        self.stop = np.append(self.start[1:], len(term))
        self.stratum, self.peak = of[self.start], self.impact[self.stop - 1]     # the last has the largest tf
        self.first_seg = np.searchsorted(term[self.start], np.arange(len(terms) + 1))

    def search(self, terms: list[str], weights: list[int], k: int, heap: list[tuple]) -> list[tuple]:
        """The k best (-score, doc_id is null, doc_id) of ``heap`` and this block."""
        here = [(self.number[t], w) for t, w in zip(terms, weights) if t in self.number and w > 0]
        if not here:
            return heap
        segs = np.concatenate([np.arange(self.first_seg[t], self.first_seg[t + 1]) for t, _ in here])
        weight = np.repeat(np.array([w for _, w in here], dtype=np.int64),
                           [self.first_seg[t + 1] - self.first_seg[t] for t, _ in here])
        bound = np.zeros(len(self.m), dtype=np.int64)
        np.add.at(bound, self.stratum[segs], weight * self.peak[segs])
        visits = np.argsort(-bound, kind="stable")
        visits = visits[bound[visits] > 0]
        reached = np.cumsum(self.docs_in[visits])
        turn = np.full(len(self.m), len(visits))
        turn[visits] = np.arange(len(visits))
        mine = turn[self.stratum[segs]]
        done, budget = 0, FIRST_DOCS
        while done < len(visits):
            if len(heap) == k and bound[visits[done]] < -heap[-1][0]:
                break                          # an equal bound may still hold a smaller doc_id
            upto = max(done + 1, int(np.searchsorted(reached, (reached[done - 1] if done else 0) + budget)))
            pick = np.flatnonzero((mine >= done) & (mine < upto))
            heap = self._visit(segs[pick], weight[pick], k, heap)
            done, budget = upto, budget * 2
        return heap

    def _visit(self, segs, weight, k, heap):
        sizes = self.stop[segs] - self.start[segs]
        at = np.repeat(self.start[segs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        docs, place = np.unique(self.docs[at], return_inverse=True)
        score = np.zeros(len(docs), dtype=np.int64)
        np.add.at(score, place, np.repeat(weight, sizes) * self.impact[at])
        if len(docs) > k:                      # ties at the k-th score stay until they are ordered by id
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= max(least, 1)
            docs, score = docs[keep], score[keep]
        found = [(-s, bool(self.null[d]), int(self.ids[d])) for d, s in zip(docs.tolist(), score.tolist()) if s > 0]
        return sorted(heap + found)[:k]


def _joined(column: pa.ChunkedArray) -> pa.Array:
    """The values of a column of lists, one after another."""
    return pa.concat_arrays([c.flatten() for c in column.chunks])


def _blocks(rows: pa.Table, asked: pa.Array) -> Iterator[tuple]:
    """Each block of a table of index rows: ids and lengths of its documents, terms, dfs, docs and tfs of those asked for."""
    block, part = rows.column("block").to_numpy(), rows.column("part").to_numpy()
    order = np.lexsort((part, block))
    for mine in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        own = rows.take(pa.array(mine))
        terms, dfs = _joined(own.column("terms")), _joined(own.column("dfs")).to_numpy()
        wanted = pc.is_in(terms, value_set=asked).to_numpy(zero_copy_only=False)
        if wanted.any():
            postings = np.repeat(wanted, dfs)
            docs, tfs = (np.frombuffer(b"".join(own.column(c).to_pylist()), "<i4")[postings] for c in ("docs", "tfs"))
            yield (_joined(own.column("ids")).to_pylist(), _joined(own.column("lengths")).to_numpy(),
                   terms.filter(pa.array(wanted)).to_pylist(), dfs[wanted], docs, tfs)


def _cells(index: DataFrame, weighted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the grid of index blocks and query blocks, with its keys i and j."""
    size = index.agg(F.sum(F.col("n_terms"))).first()[0] or 0
    asked = weighted.count()
    rows, cols = max(1, math.ceil(6 * size / CELL_BYTES)), max(1, math.ceil(asked / QUERY_TERMS))
    left = (index.withColumn("i", F.pmod(F.xxhash64("block"), F.lit(rows)))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))))
    queries = (weighted.groupBy("item", "item_id")
               .agg(F.collect_list(F.struct("term", "weight")).alias("t"))
               .select("item", "item_id", "t.term", "t.weight"))
    right = (queries.withColumn("j", F.pmod(F.xxhash64("item"), F.lit(cols)).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint")))))
    return left, right


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query with a score above 0."""
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 1
    weighted = written(weighted_terms(index, items), "lexical-queries")
    left, right = _cells(index, weighted)

    def cell(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        asked = queries.to_pylist()
        heaps: list[list[tuple]] = [[] for _ in asked]
        for held in _blocks(blocks, _joined(queries.column("term")).unique()) if asked and len(blocks) else ():
            block = Stratified(*held, n_docs, n_terms)
            for q, item in enumerate(asked):
                heaps[q] = block.search(item["term"], item["weight"], k, heaps[q])
        rows = [(a["text"], a["item_id"], None if null else ident, -score)
                for a, heap in zip(asked, heaps) for score, null, ident in heap]
        trim_memory()                          # the worker lives on beside the JVM
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.table({"text": pa.array(cols[0], pa.string()), "item_id": pa.array(cols[1], pa.int64()),
                         "doc_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    left = left.select("i", "j", "block", "part", "ids", "lengths", "terms", "dfs", "docs", "tfs")
    right = right.select("i", "j", F.col("item._text").alias("text"), "item_id", "term", "weight")
    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(
        cell, "text string, item_id bigint, doc_id bigint, score bigint")
    # rank <= k is cut in each task before the shuffle, too
    order = Window.partitionBy("item_id", "text").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def query(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build_index(docs), items, 10)


SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
           FROM documents),
d AS (SELECT doc_id, r, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
m AS (SELECT doc_id, r, terms, CAST(25 + (75 * n * nn) // ll AS BIGINT) AS m FROM d, g),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY ALL),
p AS (SELECT doc_id, r, m, term, CAST(count(*) AS BIGINT) AS tf
      FROM (SELECT doc_id, r, m, unnest(terms) AS term FROM m) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (SELECT item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""
