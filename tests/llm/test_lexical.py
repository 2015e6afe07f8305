"""Ranked lexical search against the formula over all pairs, and against SQL."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexitally.llm import lexical as L


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def corpus(n=300):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "Straße", "中文", "A1", "İ"]
    docs = []
    for i in range(n):
        size = rnd.choice([0, 1, 3, 8, 8, 8, 40, 200])
        docs.append((i, rnd.choice([" ", ", ", "-", "\x00"]).join(
            words[min(int(rnd.expovariate(0.08)), len(words) - 1)] for _ in range(size))))
    docs += [(7, docs[7][1]), (None, docs[12][1]), (None, "w1 W1 w2"), (n, None), (n + 1, ""), (n + 2, "... !"), (n + 3, "w0 " * 3000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))) for i in range(25)]
    items += [(3, items[3][1]), (4, "w1 w1 É"), (90, None), (91, ""), (92, "unseen"), (93, "w0 w0 w0")]
    return docs, items


@pytest.mark.parametrize("block, cell, first", [(1, 1, 1), (700, 2000, 4), (L.BLOCK_BYTES, L.CELL_BYTES, L.FIRST_DOCS)])
@pytest.mark.parametrize("k", [1, 10])
def test_against_all_pairs(spark, monkeypatch, block, cell, first, k):
    for name, value in (("BLOCK_BYTES", block), ("CELL_BYTES", cell), ("FIRST_DOCS", first), ("QUERY_TERMS", 20 if block > 1 else 60)):
        monkeypatch.setattr(L, name, value)
    docs, items = corpus(60 if block == 1 else 300)
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, score long, term string").repartition(3)
    q = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, `rank` int")
    got = sorted((tuple(r) for r in L.search(L.build_index(d), q, k).collect()), key=repr)
    # queries that share an id are ranked apart: both lists are there
    assert got == brute(docs, items, k)


def test_strata_are_left_out_only_below_the_kth_score():
    docs = ["a b"] + ["a " + "z " * n for n in range(1, 60)]
    postings = Counter
    block = L._Block(0)
    for i, t in enumerate(docs):
        block.add(i, Counter(L.terms_of(t)))
    names = sorted(block.postings)
    made = L.Stratified(block.ids, block.lengths, [t.decode() for t in names], [len(block.postings[t][0]) for t in names],
                        np.array([x for t in names for x in block.postings[t][0]]),
                        np.array([x for t in names for x in block.postings[t][1]]), len(docs), sum(block.lengths))
    visited = []
    original = made._visit
    made._visit = lambda segs, *rest: visited.extend(segs.tolist()) or original(segs, *rest)
    best = made.search(["a", "b"], [5, 9], 1, [])
    assert best[0][2] == 0 and postings(visited).most_common(1)[0][1] == 1
    assert len(visited) < len(made.start)


@pytest.mark.parametrize("size", [1, 90])
def test_blocks_of_many_rows(spark, monkeypatch, size):
    monkeypatch.setattr(L, "ROW_BYTES", size)
    monkeypatch.setattr(L, "BLOCK_BYTES", 4000)
    docs, items = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    q = spark.createDataFrame(items, "item_id long, text string")
    index = L.build_index(d)
    assert index.where("part > 3").count()
    assert sorted((tuple(r) for r in L.search(index, q, 5).collect()), key=repr) == brute(docs, items, 5)


def test_index_is_read_in_small_pieces(spark):
    docs = [(i, " ".join(f"w{j}" for j in range(i % 7, 40000, 7 + i % 5))) for i in range(150)]
    index = L.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).coalesce(1)
    rows = index.collect()
    assert max(len(r.docs) + len(r.tfs) + sum(len(t) + 8 for t in r.terms) for r in rows) < 300_000
    rows.sort(key=lambda r: (r.block, r.part))
    files = list(Path(re.sub("^file:/+", "/", index.inputFiles()[0])).parent.glob("*.parquet"))
    read = [pq.ParquetFile(f).metadata for f in files]
    assert max(m.row_group(g).num_rows for m in read for g in range(m.num_row_groups)) <= L.GROUP_ROWS < len(rows)
    # and it is whole
    assert sorted(i for r in rows for i in r.ids) == [i for i, _ in docs]
    assert sum(r.n_docs for r in rows) == len(docs) and sum(r.n_terms for r in rows) == sum(len(t.split()) for _, t in docs)
    held, want = Counter(), Counter(t for _, text in docs for t in set(text.split()))
    for block in {r.block for r in rows}:
        own = [r for r in rows if r.block == block]
        terms = [t for r in own for t in r.terms]
        assert [r.part for r in own] == list(range(len(own))) and terms == sorted(set(terms))
        for r in own:
            held.update(dict(zip(r.terms, r.dfs)))
            assert len(r.docs) == len(r.tfs) == 4 * sum(r.dfs)
    assert held == want


def test_short_documents_fill_a_block_too(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 50 * (1 + L.DOC_BYTES))
    docs = spark.createDataFrame([(i, "a") for i in range(200)], "doc_id long, text string").coalesce(1)
    assert [r.n_docs for r in L.build_index(docs).orderBy("block", "part").collect()] == [50] * 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(L.build_index(docs), items).count() == 0
    some = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert L.search(L.build_index(some), items.limit(0)).count() == 0
    assert [tuple(r) for r in L.search(L.build_index(some), items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_weights_of_large_corpora_stay_whole_numbers():
    made = L.Stratified([1], [10**9], ["a"], [1], np.array([0]), np.array([10**6]), 10**11, 10**13)
    assert made.m.tolist() == [25 + 75 * 10**9 * 10**11 // 10**13]
