"""Exact nearest neighbours against all distances in plain Python."""

import math
import random

import numpy as np

from lexitally.llm import ann as A


def brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
          and any(v)]
    out = {}
    for q, x in ok:
        if q % 10 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), i) for i, y in ok
                          if i != q and len(y) == len(x))
            out[q] = near[:k]
    return out


def test_against_all_distances(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(40)]                       # ties: one vector many times
    rows += [(500, [1.0, 2.0]), (510, [3.0, 4.0]), (520, None), (530, []), (540, [0.0] * 8), (550, [None] * 8),
             (560, [float("nan")] * 8), (570, [float("inf")] * 8), (None, [1.0] * 8), (580, [1e30] * 8), (590, [1e-30] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for cell, block in ((8 << 20, 1 << 20), (3000, 500)):                    # one cell, then many
        monkeypatch.setattr(A, "CELL_BYTES", cell)
        monkeypatch.setattr(A, "QUERY_BYTES", block)
        got = {}
        for r in A.nearest(df, df.where("vec_id % 10 = 0"), 5).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
        want = brute(rows, 5)
        assert {q: len(n) for q, n in got.items()} == {q: len(n) for q, n in want.items() if n}
        for q, near in want.items():
            for rank, (dist, i) in enumerate(near, 1):
                assert got[q][rank][1] == i and math.isclose(got[q][rank][0], dist, rel_tol=1e-12)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 3, (30, 40)), rng.normal(0, 1, (50, 40))
    low, high = A.tile_distances(A.Quantised(a), A.Quantised(b))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert (low <= true).all() and (true <= high).all() and (high - low).max() < 0.5


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in A.nearest(df, df.where("vec_id = 0"), 10).collect()] == [(0, 1, 1, 1.0)]
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0
