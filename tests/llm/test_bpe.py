"""BPE against the public library, on fuzzed and real texts."""

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lexitally.llm import bpe as B

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts():
    rnd = random.Random(5)
    alphabet = [chr(i) for i in range(0x250)] + list("Σαऀ中日本 　 ​́İẞ😀﻿") + [
        "<|endoftext|>", "<|startoftext|>", "'s", "'ll", " ", "  ", "\n", "\t"]
    fuzz = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return fuzz + ["", "a" * 5000, "ab" * 3000, "é" * 700, "ΣΑΣ ΑΣ.", "x<|endoftext|>", "a   b \n  c", " lead", "trail "]


@pytest.mark.parametrize("name", FILES)
def test_same_as_library(name):
    lib, own = Tokenizer.from_file(P.path(name)), B.Bpe(open(P.path(name), encoding="utf-8").read(), 64)
    for text in texts():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode_packed(own.encode_packed(text)) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_characters_of_all_planes(name):
    """Letters, numbers and case forms are those of the library's Unicode version."""
    lib, own = Tokenizer.from_file(P.path(name)), B.Bpe(open(P.path(name), encoding="utf-8").read())
    points = [c for c in (*range(0x3100), *range(0xA000, 0xAC80), *range(0xF900, 0x20000, 3), *range(0x2FA00, 0x110000, 997))
              if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 24):
        text = "".join(f"a{chr(c)}{('b', ' ', '', chr(0x301), '1')[c % 5]}" for c in points[i:i + 24])
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, ascii(text)


def test_long_words_merge_as_short_ones(monkeypatch):
    own = B.Bpe(open(P.path(FILES[1]), encoding="utf-8").read())
    words = ["internationalization" * 3, "aaaaaaabbbbbbb" * 5, "x"]
    scanned = [own.parts(w) for w in words]
    monkeypatch.setattr(B, "SHORT", 0)
    assert [own.parts(w) for w in words] == scanned


def test_part_boundaries_cover_the_word():
    own = B.Bpe(open(P.path(FILES[0]), encoding="utf-8").read())
    starts, ids = own.parts("unhappiness")
    assert starts[0] == 0 and starts == sorted(set(starts)) and len(starts) == len(ids)


def test_frame_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "y"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    lib = Tokenizer.from_file(P.path(FILES[0]))
    got = B.bpe_encode(df, P.path(FILES[0]), keep=("doc_id",), decoded_col="decoded").collect()
    assert len(got) == 4
    for r in got:
        ids = lib.encode("Hello world" if r["doc_id"] == 1 else "", add_special_tokens=False).ids
        assert B.unpack_ids(bytes(r["ids"])) == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    back = B.bpe_decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), P.path(FILES[0]), keep=("doc_id",))
    assert back.collect()[0]["decoded"] == ""
    assert B.bpe_encode(df.limit(0), P.path(FILES[0])).count() == 0


def test_query_digests(spark, tmp_path):
    from lexitally.llm.queries import QUERIES
    spark.createDataFrame([(7, "The cat's 12"), (8, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    lib = Tokenizer.from_file(P.path(FILES[0]))
    ids = lib.encode("The cat's 12", add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, str(tmp_path)).collect()}
    assert got[7]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert got[7]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert got[8]["n_tokens"] == 0 and got[8]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
