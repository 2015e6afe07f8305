"""Packing: every piece once, gapless, and close to the fewest sequences."""

import random
import zlib
from collections import Counter

import public_tokenizers as P
from tokenizers import Tokenizer

from lexitally.llm import packing as K

PATH = P.path("byte_bpe_50k.json")


def check_plan(histogram, capacity):
    patterns = K.plan_patterns(histogram, capacity)
    used = Counter()
    for times, lengths in patterns:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter({k: v for k, v in histogram.items() if v})
    return sum(t for t, _ in patterns)


def test_plan_places_every_piece():
    rnd = random.Random(2)
    for capacity in (7, 64, 2048):
        for _ in range(5):
            h = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 400)))
            assert check_plan(h, capacity) >= -(-sum(k * v for k, v in h.items()) // capacity)


def test_exact_complements_waste_nothing():
    # singles, pairs and triples that fill 100 exactly
    assert check_plan({60: 5, 40: 5}, 100) == 5
    assert check_plan({50: 4, 30: 4, 20: 4}, 100) == 4
    assert check_plan({40: 6, 30: 6, 20: 6, 10: 6}, 100) == 6
    assert check_plan({50: 7}, 100) == 4
    assert check_plan({100: 1000000, 34: 3000000}, 100) == 2500000


def test_plan_cost_follows_the_capacity_only():
    assert len(K.plan_patterns({k: 10 ** 12 for k in range(1, 2049)}, 2048)) < 6000


def test_pack_documents(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "x1", "naïve"]) for _ in range(rnd.randint(0, 90))))
            for i in range(60)] + [(100, None), (101, ""), (7, "again again"), (7, "again again"), (None, "no id")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, length string")
    lib = Tokenizer.from_file(PATH)
    got = K.pack_documents(df, PATH, capacity=50).collect()
    place, parts = {}, {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append(r)
    for spans in place.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 50
    for doc, text in docs:
        if doc == 7:
            continue
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        rows = sorted(parts[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        assert sum(r["length"] for r in rows) == len(ids)
        assert len(rows) == -(-len(ids) // 50) and all(r["length"] == 50 for r in rows[1:])
        for r in rows:
            cut = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut))
    # both rows that repeat an id are packed
    total = sum(len(lib.encode(t or "").ids) + 1 for _, t in docs)
    assert sum(r["length"] for r in got) == total
    assert len(place) <= total / 50 * 1.05 + 2


def test_empty_table_and_sequences(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert K.pack_documents(df.limit(0), PATH).count() == 0
    packed = K.sequences(K.pack_documents(df, PATH)).collect()
    assert len(packed) == 1 and packed[0]["tokens"] == 4


def test_encoder_same_as_library():
    from test_bpe import texts
    source = open(PATH, encoding="utf-8").read()
    fast, lib = K.Encoder(source), Tokenizer.from_file(PATH)
    assert fast.fast is not None
    for text in texts():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert fast.encode_packed(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    word = K.Encoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert word.fast is None and word.encode_packed("Hello") == word.bpe.encode_packed("Hello")
