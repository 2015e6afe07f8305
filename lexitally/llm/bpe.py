"""BPE encoding and decoding with public vocabularies (operator 1).

Encoding works word by word on a contiguous rank array: the part boundaries of
a word and, beside them, the rank of each adjacent pair stand in two short
lists.  The smallest rank is searched by a scan, its boundary deleted, and the
two ranks next to it refreshed, until no pair is left that merges.  A scan is
the fastest way for the few symbols of a usual word; words of more than
``SHORT`` symbols (a long run without a space) use a heap of the same ranks, so
that their cost stays near linear.  Both give the same parts.

Words repeat, so each task keeps a bounded table from word to packed ids.

Defined results: a null text is an empty text (no ids, empty decoded text);
texts are never truncated; repeated rows give repeated results; columns of the
input other than the ones named are carried only if asked for.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import Chunks, rows_of, worker_object

SHORT = 96                 # symbols; longer words use the heap
CACHE_WORDS = 1 << 17      # words kept per task before the table is emptied
NO_RANK = 1 << 62
ODD_SPACE = re.compile("[\x1c-\x1f]").search     # white space to str.split alone
# Letters, numbers and case forms of other characters change from one Unicode version to the next.
FAR = re.compile("[^\x00-\u02ff\u2000-\u206f]").search

# Fixed value: the split pattern of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """Byte -> printable character of byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the next free
    characters from 256 on.
    """
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class _Words(dict):
    """word -> packed little-endian uint32 ids; computes what is missing."""

    def __init__(self, encode_word, limit):
        super().__init__()
        self.encode_word, self.limit = encode_word, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.encode_word(word)
        return value


class Bpe:
    """A byte-level BPE vocabulary in the public ``tokenizers`` JSON format.

    Read from the file: merges, vocabulary, end-of-word suffix, the normaliser
    steps NFC / Replace / Lowercase, the split pattern, added tokens, decoder.
    Unused truncation, padding and post-processing are ignored, as with
    ``add_special_tokens=False``.

    Which characters are letters and how they are lowered is the library's own
    Unicode version; texts and chunks with characters beyond those that never
    differ (``FAR``) are normalised and split by the library's components.
    """

    def __init__(self, source: str, cache_words: int = CACHE_WORDS):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            # rank above, id of the merged symbol below: one number orders and names it
            self.pairs.setdefault((vocab[a], vocab[b]), rank << 24 | vocab[a + b])
        chars = byte_symbols()
        self.first = [vocab.get(c, -1) for c in chars]
        self.last = [vocab.get(c + self.suffix, -1) for c in chars] if self.suffix else self.first
        self.tokens = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens.update({i: t for t, i in self.added.items()})
        self.added_re = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find, self.far_find, self.drops_space = self._pattern(spec["pre_tokenizer"])
        self._read_normaliser(spec.get("normalizer"))
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if self.byte_decoder:
            back = {c: b for b, c in enumerate(chars)}
            self.pieces = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
                           for i, t in self.tokens.items()}
        self.words = _Words(self._word, cache_words)
        # chunks between blanks, each a few words: most texts need no pattern search
        self.chunks = _Words(self._chunk, 2 * cache_words)
        self.spaced = _Words(lambda c: self._chunk(" " + c), 2 * cache_words)

    def drop_tables(self) -> None:
        """Free what encoding and decoding need; :meth:`segments` still works."""
        for name in ("pairs", "tokens", "pieces", "words", "chunks", "spaced"):
            self.__dict__.pop(name, None)

    # ------------------------------------------------------------ reading
    def _read_normaliser(self, spec):
        steps = [] if not spec else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
        self.steps, whole = [], []
        for s in steps:
            if s["type"] == "NFC":
                self.steps.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
                whole.append(normalizers.NFC())
            elif s["type"] == "Replace":
                whole.append(normalizers.Replace(Regex(s["pattern"]["Regex"]), s["content"]))
                if self.drops_space and (s["pattern"]["Regex"], s["content"]) == (r"\s+", " "):
                    continue                   # white space is dropped anyway
                sub, to = regex.compile(s["pattern"]["Regex"]).sub, s["content"]
                self.steps.append(lambda t, sub=sub, to=to: sub(to, t))
            elif s["type"] == "Lowercase":
                # character by character, which up to U+02FF is what Python does
                self.steps.append(str.lower)
                whole.append(normalizers.Lowercase())
            else:
                raise ValueError(f"normaliser {s['type']} is not supported")
        self.far_steps = [normalizers.Sequence(whole).normalize_str] if whole else []

    @staticmethod
    def _pattern(spec):
        """Search for the words (a Split step's pattern, else the byte-level one), the same
        by the library, and whether white space between them is dropped."""
        steps = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        for s in steps:
            if s["type"] == "Split":
                pattern = s["pattern"]["Regex"]
                split = pre_tokenizers.Split(Regex(pattern), s["behavior"].lower(), s["invert"]).pre_tokenize_str
                return regex.compile(pattern).findall, lambda t: [w for w, _ in split(t)], (
                    s["behavior"] == "Removed" and s["invert"] and "[^\\s" in pattern)
        split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        return regex.compile(BYTE_LEVEL_PATTERN).findall, lambda t: [t[a:b] for _, (a, b) in split(t)], False

    # ------------------------------------------------------------ encoding
    def parts(self, word: str) -> tuple[list[int], list[int]]:
        """(byte offsets where parts start, ids) of one word."""
        data = word.encode("utf-8", "surrogatepass")
        if not data:
            return [], []
        ids = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        starts = list(range(len(ids)))
        if -1 in ids:                          # a byte without a symbol is dropped
            kept = [i for i, x in enumerate(ids) if x >= 0]
            starts, ids = [starts[i] for i in kept], [ids[i] for i in kept]
        if len(ids) > SHORT:
            return self._merge_long(starts, ids)
        rank_of = self.pairs.get
        ranks = [rank_of(p, NO_RANK) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFF
            del ids[i + 1], starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NO_RANK)
        return starts, ids

    def _merge_long(self, starts, ids):
        """The same merges by a heap: (rank, position) of adjacent pairs."""
        n, rank_of = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]), NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue                       # a part of this pair has changed since
            ids[i], alive[j], after[i] = rank & 0xFFFFFF, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of((ids[i], ids[after[i]]), NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of((ids[h], ids[i]), NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, h))
        kept = [i for i in range(n) if alive[i]]
        return [starts[i] for i in kept], [ids[i] for i in kept]

    def _word(self, word: str) -> bytes:
        return np.array(self.parts(word)[1], dtype="<u4").tobytes()

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """(text, id of the added token that follows it, or -1)."""
        if self.added_re is None or not any(t in text for t in self.added):
            yield text, -1
            return
        bits = self.added_re.split(text)
        for i in range(0, len(bits), 2):
            yield bits[i], self.added[bits[i + 1]] if i + 1 < len(bits) else -1

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._split(chunk)))

    def _split(self, text: str) -> list[str]:
        return self.far_find(text) if FAR(text) else self.find(text)

    def _ids(self, part: str) -> Iterator[bytes]:
        """Packed ids of a normalised text, by chunks where words can't cross them.

        If white space is dropped, no word crosses it.  Else a word may take the
        one blank before it: single blanks cut safely, runs of blanks do not.
        """
        if self.drops_space and not ODD_SPACE(part):
            return map(self.chunks.__getitem__, part.split())
        if not self.drops_space and "  " not in part:
            first, *rest = part.split(" ")
            return itertools.chain((self.chunks[first],), map(self.spaced.__getitem__, rest))
        return map(self.words.__getitem__, self._split(part))

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for part, special in self.segments(text or ""):
            for step in self.far_steps if FAR(part) else self.steps:
                part = step(part)
            out.extend(self._ids(part))
            if special >= 0:
                out.append(special.to_bytes(4, "little"))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    # ------------------------------------------------------------ decoding
    def decode_packed(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        if self.byte_decoder:
            return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")
        return " ".join(map(self.tokens.__getitem__, ids))


def worker_bpe(shared) -> Bpe:
    """The vocabulary of this Python worker, parsed once per broadcast."""
    return worker_object("bpe", "bpe", shared.id, lambda: Bpe(shared.value))


class SharedVocabulary:
    """A vocabulary file (a few MB at most) sent to the executors once."""

    MAX_BYTES = 64 << 20

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            source = f.read(self.MAX_BYTES + 1)
        if len(source) > self.MAX_BYTES:
            raise ValueError(f"{path} is too large for a vocabulary file")
        self.handle = spark.sparkContext.broadcast(source)
        self.id = self.handle._jbroadcast.id()

    @property
    def value(self):
        return self.handle.value

    def __reduce__(self):
        return _Unpickled, (self.handle, self.id)


class _Unpickled:
    def __init__(self, handle, ident):
        self.handle, self.id = handle, ident

    @property
    def value(self):
        return self.handle.value


def bpe_encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids",
               keep: tuple[str, ...] = (), decoded_col: str | None = None) -> DataFrame:
    """Encode every whole text of ``df``.

    Returns ``keep`` + ``n_tokens`` (long) + ``ids_col`` (binary: little-endian
    uint32 ids, see :func:`unpack_ids`), and with ``decoded_col`` also the text
    decoded again from those ids.  One pass, no shuffle.
    """
    shared = SharedVocabulary(df.sparkSession, vocabulary)
    src = df.select(*keep, text_col)
    fields = [f for f in src.schema.fields if f.name in keep]
    from pyspark.sql.pandas.types import to_arrow_type
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
                       + [pa.field("n_tokens", pa.int64()), pa.field(ids_col, pa.binary())]
                       + ([pa.field(decoded_col, pa.string())] if decoded_col else []))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                    + ["n_tokens bigint", f"`{ids_col}` binary"]
                    + ([f"`{decoded_col}` string"] if decoded_col else []))

    def encode(batches):
        bpe, out = worker_bpe(shared), Chunks(schema)
        for batch in batches:
            for *kept, text in rows_of(batch, *[f.name for f in fields], text_col):
                packed = bpe.encode_packed(text)
                row = (*kept, len(packed) // 4, packed)
                if decoded_col:
                    row += (bpe.decode_packed(packed),)
                yield from out.add(row, 64 + len(packed) * 3)
        yield from out.rest()

    return src.mapInArrow(encode, ddl)


def bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode packed ids; null ids decode to the empty text."""
    shared = SharedVocabulary(df.sparkSession, vocabulary)
    src = df.select(*keep, ids_col)
    fields = [f for f in src.schema.fields if f.name in keep]
    from pyspark.sql.pandas.types import to_arrow_type
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
                       + [pa.field(text_col, pa.string())])
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{text_col}` string"])

    def decode(batches):
        bpe, out = worker_bpe(shared), Chunks(schema)
        for batch in batches:
            for *kept, packed in rows_of(batch, *[f.name for f in fields], ids_col):
                text = bpe.decode_packed(packed or b"")
                yield from out.add((*kept, text), 64 + len(text))
        yield from out.rest()

    return src.mapInArrow(decode, ddl)


def unpack_ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()
