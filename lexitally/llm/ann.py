"""Nearest neighbours by a block matrix join with quantised tiles (operator 9).

Query rows and candidate rows are cut into blocks of bounded size and meet in a
grid: cell (i, j) holds candidate block i and query block j, so the work spreads
over as many tasks as there are cells and no side is broadcast or collected.

Inside a cell, vectors are quantised to int8 with a scale each.  Integer product
tiles give approximate distances; the length of what quantisation cut off bounds
their error.  A pair survives if its lower bound does not exceed the smallest
k-th upper bound known for its query; survivors are recomputed in double
precision on the original vectors and merged into a heap of k per query.  The
cells' results are merged by rank.  So the result is exact: recall is 1.

Defined results: vectors that are null, empty, all zero, or hold a null or
non-finite component take no part, nor do rows with a null id; only vectors of
equal length are compared; rows that share the query's id are not its
candidates; other repeated rows are candidates each, ties go to the smaller id;
a query row that is repeated is asked once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_BYTES = 8 << 20          # float32 bytes of a candidate block
QUERY_BYTES = 1 << 20         # float32 bytes of a query block
TILE = 2048                   # candidates of one product tile
RESULT_DDL = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("bigint").alias("vec_id"), v.alias("embedding"))


class Quantised:
    """int8 codes with a scale each, their squared lengths and what they cut off."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        approx = codes * self.scale[:, None]
        self.error = np.sqrt(((x - approx) ** 2).sum(axis=1))
        self.square = (approx ** 2).sum(axis=1)


def tile_distances(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two quantised tiles."""
    # products of int8 codes are whole numbers; float32 holds their sums exactly up to 2^24
    kind = np.float32 if a.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dots = a.codes.astype(kind) @ b.codes.astype(kind).T
    sq = a.square[:, None] + b.square[None, :] - 2 * (a.scale[:, None] * b.scale[None, :]) * dots
    dist = np.sqrt(np.maximum(sq, 0))
    rounding = 1e-6 * (np.sqrt(a.square)[:, None] + np.sqrt(b.square)[None, :])
    reach = a.error[:, None] + b.error[None, :] + rounding
    return dist - reach, dist + reach


def exact_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to rows, summed in the order of the components."""
    total = np.zeros(len(c))
    for d in range(c.shape[1]):
        diff = q[d] - c[:, d]
        total += diff * diff
    return np.sqrt(total)


def search_block(q_ids, q, c_ids, c, k: int) -> list[list[tuple[float, int]]]:
    """For each query the k nearest candidates (distance, id), nearest first."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]      # of (-distance, -id): worst on top
    quant_q = Quantised(q)
    for start in range(0, len(c_ids), TILE):
        ids, part = c_ids[start:start + TILE], c[start:start + TILE]
        low, high = tile_distances(quant_q, Quantised(part))
        own = q_ids[:, None] == ids[None, :]
        high[own] = low[own] = np.inf
        kth = (np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k
               else np.full(len(q_ids), np.inf))
        for i, heap in enumerate(heaps):
            limit = min(kth[i], -heap[0][0]) if len(heap) == k else kth[i]
            near = np.flatnonzero((low[i] <= limit) & ~own[i])
            for dist, ident in zip(exact_distances(q[i], part[near]).tolist(), ids[near].tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, (-dist, -ident))
                elif (-dist, -ident) > heap[0]:
                    heapq.heapreplace(heap, (-dist, -ident))
    return [[(-d, -i) for d, i in sorted(heap, reverse=True)] for heap in heaps]


def _matrix(table: pa.Table) -> np.ndarray:
    col = table.column("embedding").combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` to each of ``queries``.

    Both have vec_id and embedding and are filtered by :func:`usable`.
    """
    cands, asked = usable(vectors), usable(queries).dropDuplicates()
    size = F.size("embedding").cast("bigint")
    n_c = cands.agg(F.sum(size)).first()[0] or 0
    n_q = asked.agg(F.sum(size)).first()[0] or 0
    rows, cols = max(1, math.ceil(4 * n_c / CELL_BYTES)), max(1, math.ceil(4 * n_q / QUERY_BYTES))
    left = (cands.withColumn("dim", size).withColumn("i", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(rows)))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))))
    right = (asked.withColumn("dim", size).withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(cols)).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint")))))

    def cell(key, c: pa.Table, q: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(c) and len(q):
            q_ids = q.column("vec_id").to_numpy()
            found = search_block(q_ids, _matrix(q), c.column("vec_id").to_numpy(), _matrix(c), k)
            for ident, heap in zip(q_ids.tolist(), found):
                for dist, other in heap:
                    for col, value in zip(out, (ident, other, dist)):
                        col.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    keys = ("dim", "i", "j")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, RESULT_DDL)
    # rank <= k is cut in each task before the shuffle, too
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             sqrt(list_reduce(list_transform(range(1, len(q.e) + 1),
                  lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
