"""SentencePiece encoding and decoding with merge-type vocabularies (operator 12).

A text is normalised (blank -> U+2581, one blank put before it), cut into
characters, and the pairs of adjacent symbols whose joined text is a piece go on
an agenda ordered by the piece's score, the leftmost first among equal scores.
The best pair is taken off and merged, the merged symbol's new pairs go on the
agenda, and an entry whose symbols have changed since is passed over.  When the
agenda is empty, each symbol is its piece's id or, if there is none, the ids of
its bytes.

In vocabularies where U+2581 only starts pieces no merge crosses the place
before a run of blanks, so a text is encoded word by word, and each task keeps a
bounded table of words.  Other vocabularies take the whole text as one word.

``encode(check=True)`` also runs the ``sentencepiece`` library over the texts of
each Arrow batch and says row by row whether its ids and its decoded text are
the same.

Defined results: a null text is an empty text (only the begin and end ids, empty
decoded text); texts are never cut, whatever their length, and the agenda's cost
is near linear in the longest run without a blank; repeated rows give repeated
results; an empty table gives no rows.  Columns of the input are carried only if
named in ``keep``, which may hold any name but those of the result.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import Chunks, no_cycle_search, rows_of

BLANK = "▁"
CACHE_WORDS = 1 << 18      # words kept per task before the table is emptied
LONG = 32                  # longer words have an agenda of their own and are not kept
ROWS = 1 << 14             # words of one length that are encoded together
TEXTS_BYTES = 2 << 20      # characters of texts that are encoded together, one text at least
NO_PIECE = (1 << 62) - 1

# Kinds of pieces in the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_MODEL = 2


# ------------------------------------------------------------ the model file
def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if data[i - 1] < 128:
            return value, i


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            if kind == 2:
                size, i = _varint(data, i)
            else:
                size = {1: 8, 5: 4}[kind]
            value, i = data[i:i + size], i + size
        yield key >> 3, value


def _slot(keys: np.ndarray, multiplier: int, size: int) -> np.ndarray:
    """Slot of each key in a table of ``size`` (a power of two): the product's upper bits."""
    return (keys.astype(np.uint64) * np.uint64(multiplier) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _slots(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(multiplier, keys, values) of hash tables that hold each key in one of them: a slot takes
    one of its keys, the others go to the next table."""
    out, multiplier = [], 0x9E3779B97F4A7C15
    while len(keys):
        size = 1 << max(10, (4 * len(keys)).bit_length())
        at = _slot(keys, multiplier, size)
        held, kept = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        held[at], kept[at] = keys, values
        out.append((multiplier, held, kept))
        left = held[at] != keys
        keys, values = keys[left], values[left]
        multiplier = multiplier * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1
    return out


class Pieces:
    """A merge-type vocabulary in the public ``.model`` format."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, norm = {}, {}
        for number, value in wire_fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in wire_fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(wire_fields(value))
            elif number == 3:
                norm = dict(wire_fields(value))
        if trainer.get(3) != MERGE_MODEL:
            raise ValueError("only merge-type vocabularies are supported")
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only vocabularies that leave texts as they are but for blanks are supported")
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("vocabularies with user-defined or unused pieces are not supported")
        self.prefix = bool(norm.get(3, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        # every way to join two pieces to a third: the rank of its score above (the highest
        # first; equal scores share a rank), its id below
        rank = {x: r for r, x in enumerate(sorted(set(scores), reverse=True))}
        self.merges = {(self.ids[p[:cut]], self.ids[p[cut:]]): rank[scores[i]] << 24 | i
                       for p, i in self.ids.items() for cut in range(1, len(p))
                       if p[:cut] in self.ids and p[cut:] in self.ids}
        self.begin, self.end = self._special(trainer, 46, "<s>"), self._special(trainer, 47, "</s>")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.fallback = bool(trainer.get(35, 0)) and len(self.byte_ids) == 256
        self.by_word = all(BLANK not in p.lstrip(BLANK) for p in self.ids)
        self.slots = _slots(np.array([a << 21 | b for a, b in self.merges], dtype=np.int64),
                            np.array(list(self.merges.values()), dtype=np.int64))
        # symbol of every character: its piece, or a number from the number of pieces on
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + len(self.pieces)
        for c, i in self.chars.items():
            self.symbol_of[ord(c)] = i
        # decoding: bytes of each id; control pieces are invisible
        self.surface = trainer.get(44, " ⁇ ".encode())
        self.text = np.array([self._text(i) for i in range(len(self.pieces))], dtype=object)
        self.is_byte = np.array([k == BYTE for k in self.kinds])

    def _special(self, trainer: dict, number: int, default: str) -> int:
        return self.pieces.index(trainer.get(number, default.encode()).decode())

    def _text(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.surface
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return self.pieces[i].replace(BLANK, " ").encode()

    # ------------------------------------------------------------ encoding
    def symbols(self, word: str) -> list[int]:
        """Ids of one word's symbols once no pair on the agenda is left; a character that
        is no piece counts from the number of pieces on."""
        ids = [self.chars.get(c) or len(self.pieces) + ord(c) for c in word]
        merged, n, pop, push = self.merges.get, len(ids), heapq.heappop, heapq.heappush
        # an entry is one number: the rank of the joined piece above, the left place below
        agenda = [m >> 24 << 32 | i for i, m in enumerate(map(merged, zip(ids, ids[1:]))) if m is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = pop(agenda)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or (m := merged((ids[i], ids[j]))) is None or m >> 24 != entry >> 32:
                continue                       # a symbol of this pair has changed since
            ids[i] = new = m & 0xFFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merged((new, ids[k]))) is not None:
                    push(agenda, m >> 24 << 32 | i)
            h = before[i]
            if h >= 0 and (m := merged((ids[h], new))) is not None:
                push(agenda, m >> 24 << 32 | h)
        return [x for x in ids if x >= 0]

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and id of the piece that each pair joins to, NO_PIECE where there is none."""
        key = left.astype(np.int64) << 21 | right
        out, ask, where = np.full(key.size, NO_PIECE), key.ravel(), np.arange(key.size)
        for multiplier, keys, joined in self.slots:
            at = _slot(ask, multiplier, len(keys))
            held = keys[at]
            hit = held == ask
            out[where[hit]] = joined[at[hit]]
            left = (held >= 0) & ~hit                  # a pair whose slot is empty is in no table
            ask, where = ask[left], where[left]
            if not len(ask):
                break
        return out.reshape(key.shape)

    def pack_all(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of one length: a row of the matrix is a word's agenda, and each
        round takes the best entry off every row that has one left."""
        n, width = len(words), len(words[0])
        ids = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")].reshape(n, width)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        agenda = self._joined(ids[:, :-1], ids[:, 1:])
        while True:
            best = (agenda >> 24).argmin(axis=1) if agenda.shape[1] else np.zeros(len(rows), np.int64)
            entry = agenda[np.arange(len(rows)), best] if agenda.shape[1] else np.full(len(rows), NO_PIECE)
            done = entry == NO_PIECE
            self._put(out, rows[done], ids[done])
            rows, best, entry = rows[~done], best[~done], entry[~done]
            if not len(rows):
                return out
            # every row that is left loses one symbol: the merged pair's right one
            ids, agenda = ids[~done], agenda[~done]
            each, width = np.arange(len(rows)), ids.shape[1] - 1
            keep = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            ids = np.take_along_axis(ids, keep, axis=1)
            ids[each, best] = entry & 0xFFFFFF
            keep = np.arange(width - 1)[None, :]
            agenda = np.take_along_axis(agenda, keep + (keep >= best[:, None]), axis=1)
            for place, inside in ((best - 1, best > 0), (best, best < width - 1)):
                r, p = each[inside], place[inside]
                agenda[r, p] = self._joined(ids[r, p], ids[r, p + 1])

    def _put(self, out: list[bytes], rows: np.ndarray, ids: np.ndarray) -> None:
        """Pack rows of symbols of one width into their places of ``out``."""
        size, data = 4 * ids.shape[1], ids.astype("<u4").tobytes()
        for k, row in enumerate(rows.tolist()):
            out[row] = data[k * size:(k + 1) * size]
        for k in np.flatnonzero((ids >= len(self.pieces)).any(axis=1)).tolist():
            out[rows[k]] = self._pack(ids[k].tolist())

    def _pack(self, ids: list[int]) -> bytes:
        n = len(self.pieces)
        if max(ids) >= n:
            ids = [y for x in ids for y in ((x,) if x < n else self._fallback(chr(x - n)))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _fallback(self, char: str) -> list[int]:
        """A character that is no piece: the ids of its bytes."""
        if not self.fallback:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def split(self, text: str) -> list[str]:
        """The words of a text that are encoded one by one; blanks are U+2581."""
        text = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        if not self.by_word:
            return [text]
        if BLANK + BLANK in text:
            return re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", text)
        first, *rest = text.split(BLANK)
        return [first] * bool(first) + [BLANK + w for w in rest]

    def pack_words(self, words: set[str], table: dict[str, bytes]) -> None:
        """Put the packed ids of ``words`` into ``table``."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG:
                table[w] = self._pack(self.symbols(w))
            else:
                by_length.setdefault(len(w), []).append(w)
        for same in by_length.values():
            for start in range(0, len(same), ROWS):
                part = same[start:start + ROWS]
                table.update(zip(part, self.pack_all(part)))

    def encode_all(self, texts: list[str | None], table: dict[str, bytes]) -> list[bytes]:
        """Ids of whole texts, with begin and end, as little-endian unsigned 32-bit integers.

        ``table`` holds the packed ids of words met before; it is emptied when full, and
        does not keep long words.
        """
        split = [self.split(t) if t else [] for t in texts]
        if len(table) >= CACHE_WORDS:
            table.clear()
        new = set().union(*split).difference(table)
        self.pack_words(new, table)
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        out = [b"".join([begin, *map(table.__getitem__, words), end]) for words in split]
        for w in new:
            if len(w) > LONG:
                del table[w]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text], {})[0], dtype="<u4").tolist()

    # ------------------------------------------------------------ decoding
    def decode_packed(self, packed: bytes) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, the blank put before it removed."""
        ids = np.frombuffer(packed, dtype="<u4")
        data = b"".join(self.text.take(ids).tolist())
        if self.prefix:
            data = data[self._drop(ids):]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _drop(self, ids: np.ndarray) -> int:
        """1 if the first visible piece is one that starts with a blank."""
        for i in ids.tolist():
            if self.kinds[i] != CONTROL:
                return int(self.kinds[i] == NORMAL and self.pieces[i].startswith(BLANK))
        return 0

    def _decode_runs(self, ids: np.ndarray) -> str:
        """As above where byte pieces are no UTF-8: each byte of a run that starts no character
        becomes U+FFFD."""
        out, run, drop = [], bytearray(), self._drop(ids) if self.prefix else 0

        def flush():
            i = 0
            while i < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i:i + size]).decode())
                    except UnicodeDecodeError:
                        continue
                    i += size
                    break
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids.tolist():
            if self.kinds[i] == BYTE:
                run.extend(self.text[i])
                continue
            flush()
            out.append(self.text[i].decode())
        flush()
        return "".join(out)[drop:]


# ------------------------------------------------------------ in Spark
class SharedModel:
    """A model file (a few MB at most) sent to the executors once."""

    MAX_BYTES = 64 << 20

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            model = f.read(self.MAX_BYTES + 1)
        if len(model) > self.MAX_BYTES:
            raise ValueError(f"{path} is too large for a vocabulary file")
        self.handle = spark.sparkContext.broadcast(model)


@functools.lru_cache(maxsize=1)
def worker_pieces(model: bytes) -> Pieces:
    """The vocabulary of this Python worker; its size is bounded by the model file's."""
    return Pieces(model)


def groups(batches, *names: str) -> Iterator[list[tuple]]:
    """Rows of Arrow batches, as many together as have texts of about TEXTS_BYTES (the last column)."""
    rows, size = [], 0
    for batch in batches:
        for row in rows_of(batch, *names):
            rows.append(row)
            size += len(row[-1] or "") + 16
            if size >= TEXTS_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _library(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _carried(src: DataFrame, keep: tuple[str, ...], own: set[str]) -> tuple[list, str]:
    if clash := own & set(keep):
        raise ValueError(f"names of the result cannot be carried: {sorted(clash)}")
    fields = [src.schema[c] for c in keep]
    return ([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields],
            "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields))


def encode(df: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = (),
           decode: bool = False, check: bool = False) -> DataFrame:
    """Encode every whole text of ``df`` in one pass without a shuffle.

    Returns ``keep`` + n_tokens (long) + ids (binary: little-endian uint32, begin and
    end included), with ``decode`` also decoded (string), and with ``check`` also agrees
    (boolean): the library gives the same ids and, with ``decode``, the same text.
    """
    handle = SharedModel(df.sparkSession, model).handle
    fields, ddl = _carried(df, keep, {"n_tokens", "ids", "decoded", "agrees"})
    schema = pa.schema(fields + [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())]
                       + [pa.field("decoded", pa.string())] * decode + [pa.field("agrees", pa.bool_())] * check)
    ddl += "n_tokens bigint, ids binary" + ", decoded string" * decode + ", agrees boolean" * check

    def run(batches):
        own, out, table = worker_pieces(handle.value), Chunks(schema), {}
        library = _library(handle.value) if check else None
        for rows in groups(batches, *keep, text_col):
            texts = [row[-1] for row in rows]
            coded = own.encode_all(texts, table)
            theirs = library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1) if check else []
            for i, ((*kept, _), packed) in enumerate(zip(rows, coded)):
                row = [*kept, len(packed) // 4, packed]
                if decode:
                    row.append(own.decode_packed(packed))
                if check:
                    same = struct.pack(f"<{len(theirs[i])}I", *theirs[i]) == packed
                    row.append(same and (not decode or library.decode(theirs[i]) == row[-1]))
                yield from out.add(tuple(row), 64 + 3 * len(packed))
        yield from out.rest()

    def quietly(batches):
        with no_cycle_search():
            yield from run(batches)

    return df.select(*[f"`{c}`" for c in keep], text_col).mapInArrow(quietly, ddl)


def decode(df: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` + decoded: the text of packed ids; null ids decode to the empty text."""
    handle = SharedModel(df.sparkSession, model).handle
    fields, ddl = _carried(df, keep, {"decoded"})
    schema = pa.schema(fields + [pa.field("decoded", pa.string())])

    def run(batches):
        own, out = worker_pieces(handle.value), Chunks(schema)
        for batch in batches:
            for *kept, packed in rows_of(batch, *keep, ids_col):
                text = own.decode_packed(packed or b"")
                yield from out.add((*kept, text), 64 + len(text))
        yield from out.rest()

    return df.select(*[f"`{c}`" for c in keep], ids_col).mapInArrow(run, ddl + "decoded string")
