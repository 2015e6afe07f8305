"""SentencePiece merges against the public library, on fuzzed and real texts."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from lexitally.llm import piece as S

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return S.Pieces(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def fuzz():
    rnd = random.Random(7)
    some = [chr(i) for i in range(0x250)] + list("▁▁中日😀﻿�   ") + [" "] * 60 + ["the", "ing", "<s>", "</s>", "<unk>", "<0x41>"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    every = ["".join(chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x110000)]))
                     for _ in range(rnd.randint(1, 8))) for _ in range(1500)]
    return texts + every + ["", " ", "a ", " " * 4001, "a" * 5000, "\x00a", "ab " * 3000, "é" * 700] + [" " * n + "x" for n in range(2, 40)]


def test_same_ids_and_text_as_the_library(own, library):
    texts = fuzz()
    theirs = library.encode(texts, add_bos=True, add_eos=True)
    for text, ids, packed in zip(texts, theirs, own.encode_all(texts, {})):
        assert S.np.frombuffer(packed, "<u4").tolist() == ids, text
        assert own.decode_packed(packed) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(own, library):
    rnd = random.Random(9)
    for _ in range(4000):
        ids = [rnd.randrange(300) if rnd.random() < 0.7 else rnd.randrange(32000) for _ in range(rnd.randint(0, 12))]
        assert own.decode_packed(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_matrix_of_agendas_equals_single_agendas(own):
    rnd = random.Random(3)
    for width in (1, 2, 5, 17):
        words = ["".join(rnd.choice("▁thernigsaé\n") for _ in range(width)) for _ in range(300)]
        assert own.pack_all(words) == [own._pack(own.symbols(w)) for w in words]


def test_word_table_is_emptied_and_keeps_no_long_words(own, monkeypatch):
    monkeypatch.setattr(S, "CACHE_WORDS", 3)
    table = {}
    first = own.encode_all(["a b c d " + "x" * 100], table)
    assert all(len(w) <= S.LONG for w in table)
    assert own.encode_all(["a b c d " + "x" * 100], table) == first


def test_other_models_are_refused(own):
    with pytest.raises(ValueError):
        S.Pieces(b"")


def test_frame_nulls_repeats_and_extra_columns(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "y"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n_tokens` string")
    got = S.encode(df, MODEL, keep=("doc_id",), decode=True, check=True).collect()
    assert len(got) == 4
    for r in got:
        text = "Hello world" if r["doc_id"] == 1 else ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == text and r["agrees"]
    with pytest.raises(ValueError):
        S.encode(df, MODEL, keep=("doc_id", "n_tokens"))
    carried = S.encode(df.withColumnRenamed("n_tokens", "decoded text"), MODEL, keep=("decoded text",))
    assert carried.columns == ["decoded text", "n_tokens", "ids"] and carried.count() == 4
    assert S.encode(df.limit(0), MODEL).count() == 0
    back = S.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), MODEL, keep=("doc_id",))
    assert back.collect()[0]["decoded"] == ""


def test_query_digests(spark, tmp_path, library):
    from lexitally.llm.queries import QUERIES
    texts = {7: "The cat's  12\n", 8: None, 9: "a▁b"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op12_sentencepiece"](spark, str(tmp_path)).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r["n_tokens"] == len(ids)


def test_joined_pairs_by_hash(own):
    """Every pair that joins is found with its rank and id, whichever table holds it; others are not."""
    left, right = np.array(list(own.merges)).T
    assert (own._joined(left, right) == np.array(list(own.merges.values()))).all()
    assert sum(int((keys >= 0).sum()) for _, keys, _ in own.slots) == len(own.merges)
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, len(own.pieces) + 0x110000, (2, 50, 400))
    want = [[own.merges.get(p, S.NO_PIECE) for p in zip(x, y)] for x, y in zip(a.tolist(), b.tolist())]
    assert own._joined(a, b).tolist() == want
    assert own._joined(a[:, :0], b[:, :0]).shape == (50, 0)
