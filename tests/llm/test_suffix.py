"""Repeated windows against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from lexitally.llm import suffix as S


def brute(texts, threshold):
    """(n_removed, n_spans, kept) per text, from every window of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + threshold] for d in data for i in range(len(d) - threshold + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - threshold + 1):
            if seen[d[i:i + threshold]] > 1:
                gone[i:i + threshold] = b"\1" * threshold
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus(seed, threshold):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(threshold // 3), text(threshold // 2), text(threshold)]
    docs = [text(rnd.randint(0, threshold)) for _ in range(12)]
    docs += [text(10) + " " + rnd.choice(passages) + " " + text(15) for _ in range(12)]
    base = text(threshold)
    for _ in range(10):                                     # near copies: one change each
        at = rnd.randrange(len(base))
        docs.append(base[:at] + "#" + base[at + 1:])
    docs += [base, base, base + passages[0], "la " * threshold, "x" * (3 * threshold), None, "", "short",
             passages[1] + passages[1], passages[2][5:-5]]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    threshold = 64
    docs = corpus(seed, threshold)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in S.remove_repeats(df, threshold=threshold).collect()}
    for i, (removed, runs, kept) in enumerate(brute(docs, threshold)):
        r = got[i]
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == (removed, runs, kept), i
        assert r["n_bytes"] == len((docs[i] or "").encode())


def test_production_threshold_and_query(spark, tmp_path):
    docs = corpus(9, 400)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, uid string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    from lexitally.llm.queries import QUERIES
    got = {r["doc_id"]: r for r in QUERIES["op2_suffix_dedup"](spark, str(tmp_path)).collect()}
    for i, (removed, runs, kept) in enumerate(brute(docs, 400)):
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (removed, runs)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_long_texts_in_parts(spark, monkeypatch):
    """Texts longer than a part are cut with an overlap and lose nothing."""
    docs = corpus(4, 64)
    joined = " ".join(t for t in docs if t)
    runs = {}
    for part in (1 << 20, 300):
        monkeypatch.setattr(S, "PART", part)
        rows = [(1, joined), (2, joined[100:])]
        runs[part] = [
            (len(p), [(u, b) for u, b, _ in p]) for p in S._pieces(iter(rows), 64)]
        covered = {u: set() for u, _ in rows}
        for group in S._pieces(iter(rows), 64):
            for u, base, data in group:
                covered[u] |= set(range(base, base + len(data) - 63))
        for u, t in rows:
            assert covered[u] == set(range(len(t.encode()) - 63))


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(900))
    df = spark.createDataFrame([(1, text), (1, text), (None, None), (3, "é")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in S.remove_repeats(df).collect())
    assert got == [(0, 0), (1, 900), (1, 900), (3, 0)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_valid_text(spark):
    a = "é" * 300 + "end one"
    df = spark.createDataFrame([(1, a, "en", "s", len(a)), (2, "q" + a, "en", "s", 1 + len(a)), (3, None, None, None, None)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = S.stage(spark, df, "")
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[3]["text"] is None and got[3]["n_chars"] is None
    for i in (1, 2):
        assert got[i]["n_chars"] == len(got[i]["text"]) < 20


def test_short_texts_are_hashed_in_small_groups():
    """The arrays of a group are many times its size and live beside the JVM."""
    rows = [(i, "x" * 4000) for i in range(1000)]
    groups = list(S._pieces(iter(rows), 400))
    assert max(sum(len(p) for _, _, p in g) for g in groups) <= 1 << 19
    assert [u for g in groups for u, _, _ in g] == list(range(1000))
    long = list(S._pieces(iter([(1, "y" * (3 << 20)), (2, "z" * 500)]), 400))
    assert all(long) and {u for g in long for u, _, _ in g} == {1, 2}


def test_stage_cuts_texts_in_one_function(spark):
    """Two Python functions in a task are two workers beside the JVM."""
    df = spark.createDataFrame([(1, "a" * 900, "en", "s", 900)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    plan = S.stage(spark, df, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_stage_removes_short_passages_of_over_fifty_words(spark):
    """A repeated passage of 51 words goes although it has less than 400 bytes; one of 50 words stays."""
    words = [f"w{i:03d}" for i in range(51)]
    passage, shorter = " ".join(words), " ".join(w[::-1] for w in words[:50])
    texts = [f"one {passage}. first", f"two ({passage}) second", f"three {shorter}! third", f"four: {shorter}? fourth", "la " * 300]
    assert 200 < len(shorter) < len(passage) < 400
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.stage(spark, df, "").collect()}
    want = ["one. first", "two () second", *texts[2:4]]
    for i, t in enumerate(want):
        assert got[i][0].replace(" .", ".") == t and got[i][1] == len(got[i][0])
    assert got[4][1] < 20                                # 400 bytes go whatever their words
