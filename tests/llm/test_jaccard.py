"""Components and sets against plain Python over all pairs."""

import random

import numpy as np
import pytest

from lexitally.llm import jaccard as J


def plain_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    sets = {i: plain_set(t) for i, t in docs}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    docs = [text(rnd.randint(0, 60)) for _ in range(30)]
    passage = text(40)
    docs += [text(rnd.randint(0, 25)) + passage + text(rnd.randint(0, 25)) for _ in range(25)]
    for size, copies in ((30, 12), (80, 40), (200, 12)):          # chains of near copies
        base = text(size)
        for _ in range(copies):
            base = list(base)
            for _ in range(rnd.randint(0, 2)):
                base[rnd.randrange(size)] = word()
            docs.append(base)
    docs += [["One", "two"], ["one", "TWO"], ["one"], [], docs[-1], docs[-1]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    docs = corpus(seed) + [(5000, None), (5001, " \t\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_only_ascii_letters_are_lowered(spark):
    a = J.shingles("Ä ONE two three four", {}.__class__ and J._Hashes())
    assert (a == J.shingles("Ä one TWO three four", J._Hashes())).all()
    assert (a != J.shingles("ä one two three four", J._Hashes())).all()


def test_t_occurrence_against_counting():
    rnd = random.Random(3)
    for _ in range(60):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 30))) for _ in range(rnd.randint(1, 12))]
        counts = {}
        for x in lists:
            for m in x:
                counts[m] = counts.get(m, 0) + 1
        for need in (1, 2, 5, len(lists)):
            for longest in (0, 1, need - 1, 50):
                assert J.t_occurrence(lists, need, longest) == {m: c for m, c in counts.items() if c >= need}


def test_search_is_exact():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        q = np.unique(rnd.integers(0, 60, 50))
        cands = [np.unique(np.concatenate([rnd.choice(q, 35), rnd.integers(0, 90, rnd.integers(1, 20))]))
                 for _ in range(30)]
        want = [i for i, c in enumerate(cands)
                if 100 * len(np.intersect1d(q, c)) >= 80 * len(np.union1d(q, c))]
        assert J.search(q, cands) == want


def test_null_and_repeated_ids_and_empty(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(4, t, 1), (4, t, 1), (None, t, 2), (9, t + " k", 3), (None, None, 4)],
                               "doc_id long, text string, cls long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 6, 4), (4, 6, 4), (None, 6, 4), (9, 7, 4), (None, 0, None)], key=str)
    kept = J.stage(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 4]
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_signature_bounds_the_difference():
    rnd = np.random.default_rng(5)
    for size in (1, 20, 300, 5000):
        for _ in range(10):
            a = np.unique(rnd.integers(0, 1 << 62, size))
            b = np.unique(np.concatenate([rnd.choice(a, max(1, size * 4 // 5), replace=False),
                                          rnd.integers(0, 1 << 62, size // 5)]))
            bits = sum(int(x).bit_count() for x in (J.signature(a) ^ J.signature(b)).view(np.uint64))
            assert len(J.signature(a)) == J.SIGNATURE and bits <= len(np.setxor1d(a, b))
            assert not (J.signature(a) ^ J.signature(a)).any()


@pytest.mark.parametrize("seed", [3, 4])
def test_large_group_of_near_copies(spark, seed):
    """Members about the threshold apart: some link, hundreds link with nobody."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(90)]
    docs = []
    for i in range(300):
        own = list(base)
        for at in rnd.sample(range(90), rnd.choice((0, 1, 1, 2, 2, 3, 4))):
            own[at] = word()
        docs.append((i, " ".join(own[:rnd.choice((90, 90, 80, 72))])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df).collect()}
    want = brute(docs)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_texts_without_ids(spark):
    """Each text without an id is read for its own class; links reach texts with ids."""
    t = [f"{c} b c d e f g h i j k l m n o p q r s t u v w x y z" for c in "123456"]
    df = spark.createDataFrame([(None, t[0]), (None, t[1]), (None, "some other words that link with nobody here"),
                                (None, t[0]), (7, t[2]), (3, t[3]), (None, t[4].upper())], "doc_id long, text string")
    got = J.near_duplicates(df).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["3"] * 6 + ["None"]
