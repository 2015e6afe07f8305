"""Cross-tokenizer alignment against a plain reading of its definition, over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexitally.llm import align as A
from lexitally.llm.bpe import byte_symbols

FILES = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, groups, links), or None without tokens; no spans, no dictionaries."""
    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    back = {c: b for b, c in enumerate(byte_symbols())}

    def cut(text):
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        tokens = ([bytes(back[c] for c in a_lib.id_to_token(i)) for i in a],
                  [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i)
                   else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b])
        if not text or any(b"".join(t) != (" " + text).encode() for t in tokens):
            return None
        ranges = []
        for side in tokens:
            end, out = 0, []
            for t in side:
                out.append((end, end + len(t)))
                end += len(t)
            ranges.append(out)
        low, groups = 0, []
        for end in sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]}):
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, side) if low < e <= end)
                                   for ids, side in zip((a, b), ranges)))
            low = end
        links = [(i, j) for i, (s, e) in zip(a, ranges[0]) for j, (t, f) in zip(b, ranges[1]) if s < f and t < e]
        return a, b, groups, links
    return cut


def texts():
    rnd = random.Random(11)
    some = [" "] * 8 + list("\n\t\xa0  ") + ["the", "ing", "a'", "'s", "'ll", "é", " \n", "<|endoftext|>", "<s>", "12", "!!", "中", "😀"]
    out = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    out += ["".join(chr(rnd.randrange(1, 0x2100)) for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    return out + ["a▁b c", "▁", " ", "  ", "a ", "x" * 3000, "word " * 500, "\n" * 50, " " * 300]


def test_groups_and_links_of_whole_texts(plain):
    tool = A.Aligner(open(FILES[0], "rb").read(), FILES[1], open(FILES[2], "rb").read())
    for text in texts():
        want = plain(text)
        spans = tool.spans(text) if text else []
        assert "".join(spans) == (" " + text if text else "")
        found = tool.cut(spans)
        if want is None:
            assert not found or None in found, text
            continue
        assert ";".join(s.groups.decode() for s in found) == ";".join(want[2]), text
        assert sorted(x for s in found for x in A.np.frombuffer(s.links, A.np.int64).tolist()) == sorted(i << 32 | j for i, j in want[3]), text


def test_a_full_table_keeps_the_spans_in_use(monkeypatch):
    monkeypatch.setattr(A, "SPANS", 3)
    known = {" a": 1, " b": 2, " c": 3}
    assert A.room(known, {" a", " c"}, 0) is known
    assert A.room(known, {" a", " c", " d"}, 1) == {" a": 1, " c": 3}


def test_spans_that_do_not_join_stand_alone(plain):
    """One span without tokens leaves those that are aligned with it as they are."""
    tool = A.Aligner(open(FILES[0], "rb").read(), FILES[1], open(FILES[2], "rb").read())
    good, bad = [" the", " cats'", " 1,250"], " a▁b"
    assert tool.cut([]) == [] and tool.cut([bad]) == [None]
    assert tool.cut([good[0], bad, *good[1:]]) == [tool.cut([w])[0] if w != bad else None for w in (good[0], bad, *good[1:])]
    assert None not in tool.cut(good)


def test_a_block_adds_up_its_documents(plain):
    """Sums come from the block's spans, with repeats; a document with a span without tokens has none."""
    import pyarrow as pa
    tool = A.Aligner(open(FILES[0], "rb").read(), FILES[1], open(FILES[2], "rb").read())
    texts = ["the cats the cats' the", "1,250 the", "", "x the"]
    words = [tool.spans(t) if t else [] for t in texts]
    known = {w: tool.cut([w])[0] for ws in words for w in ws}
    block = A._Block(7)
    for i, ws in enumerate(words):
        block.add(i, ws, known, i != 3)
    i64s, names = pa.list_(pa.int64()), ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = block.rows(pa.schema([(n, pa.int64()) for n in names] + [("groups_sha256", pa.string()), ("spans", pa.binary()), (
        "uses", pa.binary()), ("pairs", i64s), ("linked", i64s), ("starts", pa.binary()), ("members", pa.binary())]))
    want = [plain(t) for t in texts[:2]]
    assert [tuple(r[n] for n in names[1:]) for r in out.to_pylist()] == [
        *((i, len(a), len(b), len(g), len(x)) for i, (a, b, g, x) in enumerate(want)), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert sum(out.column("linked")[0].as_py()) == sum(len(x) for *_, x in want)


@pytest.mark.parametrize("spans", [1, 1 << 18])
@pytest.mark.parametrize("block", [1, 200, A.BLOCK_CHARS])
def test_counts_over_the_corpus(spark, plain, monkeypatch, block, spans):
    monkeypatch.setattr(A, "BLOCK_CHARS", block)
    monkeypatch.setattr(A, "SPANS", spans)
    rows = [(i, t) for i, t in enumerate(texts()[::9])] + [(1, "the ing the"), (1, "the ing the"), (None, "the 12"), (5000, None), (5001, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_a int").repartition(3)
    got = Counter(tuple(r) for r in A.alignment(df, *FILES).collect())
    cuts = [(i, plain(t or "")) for i, t in rows]
    count = Counter(link for _, c in cuts if c for link in c[3])
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    want = Counter()
    for i, c in cuts:
        want[(i, 0, 0, 0, 0, 0, 0, "") if c is None else (
            i, len(c[0]), len(c[1]), len(c[2]), len(c[3]), sum(count[x] == most[x[1]] for x in c[3]),
            sum(count[x] for x in c[3]), hashlib.sha256(";".join(c[2]).encode()).hexdigest())] += 1
    assert got == want


def test_empty_table_and_table_without_tokens(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment(df, *FILES).count() == 0
    none = spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in A.alignment(none, *FILES).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_links_of_one_text(plain):
    got = A.links("the cats' 1,250", *FILES)
    assert [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in got] == plain("the cats' 1,250")[2]
    assert A.links("a▁b", *FILES) == [] and A.links("", *FILES) == []
