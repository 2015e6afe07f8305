"""Suffix-array deduplication of repeated passages (operator 2).

Every byte covered by a string of ``threshold`` bytes that also starts anywhere
else (same text included) is removed.  The suffixes of all texts are sorted only
through their first ``threshold`` bytes, by radix passes that keep equal groups
and drop groups of one:

1. The first digit of a suffix is the smallest-hashed ``GRAM`` bytes within its
   first ``threshold`` bytes, with the place they have there.  Neighbouring
   suffixes share that place in the text, so they travel as one run; there are
   about ``threshold / 2`` suffixes in a run.  Equal strings have equal digits, so
   a digit found once needs no further pass, and runs that are equal as a whole
   are equal suffix by suffix.
2. Runs that share a digit but are not equal as a whole are cut into blocks of
   ``BLOCK`` suffixes; the second digit is what all strings of a block have in
   common.  Blocks found once are dropped, equal blocks are repeats.
3. The last digit is what is left of each string: a few bytes on either side.
   It is compared as it is, suffix by suffix, and equal groups are exactly the
   repeated windows.

Each pass is an aggregate by digit (copies are counted before the shuffle, so a
passage that a third of all texts share is one row per task), and no group is
ever collected: a group is only its count.

The pipeline's stage removes passages of over ``PASSAGE_WORDS`` words, which may be
shorter than ``THRESHOLD``: it looks for strings of ``PASSAGE_BYTES`` and keeps the
maximal runs of them that have neither so many words nor ``THRESHOLD`` bytes.

Defined results: a null text is empty; texts shorter than ``threshold`` keep
everything; repeated rows repeat each other's strings and lose them all;
removed runs may cut characters (``kept`` is binary, see ``stage``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunks, discard, frugal, masked_columns, mix64, names_of, release, rows_of, written

THRESHOLD = 400
PASSAGE_WORDS = 50                # the stage removes passages of more words than this
PASSAGE_BYTES = 200               # and looks for strings of this length: 51 words of prose have more
GRAM = 16
BLOCK = 32
ROWS = 1 << 10                    # rows of a batch cut together
PART = 1 << 20                    # longest part of a text hashed at a time (positions take 24 bits)
GROUP = 1 << 19                   # bytes of several texts hashed together
_BASE = 0x9E3779B97F4A7C15
RUN_DDL = "uid bigint, lo int, hi int, anchor int, digit bigint, whole bigint, copies bigint"
RUN_SCHEMA = pa.schema([("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int32()),
                        ("digit", pa.int64()), ("whole", pa.int64()), ("copies", pa.int64())])
BLOCK_DDL = ("uid bigint, lo int, hi int, first int, last int, core bigint, edges bigint, "
             "left_bytes binary, right_bytes binary, open boolean")
BLOCK_SCHEMA = pa.schema([
    ("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.int32()), ("last", pa.int32()),
    ("core", pa.int64()), ("edges", pa.int64()), ("left_bytes", pa.binary()), ("right_bytes", pa.binary()),
    ("open", pa.bool_())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position (polynomial, then mixed)."""
    h = data.astype(np.uint64) + np.uint64(1)
    width, base = 1, _BASE
    while width < GRAM:                                    # double the width of the hashed string
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & (1 << 64) - 1, width * 2
    return mix64(h)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[x : x + width] for every x: running minima in blocks of ``width``."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def runs_of(data: bytes, ends: np.ndarray, threshold: int):
    """Runs of suffixes in texts laid end to end.

    ``ends``: where each text ends.  Returns arrays (first start, number of
    starts, place of the digit, hash of the digit) in order of the text.
    """
    if len(data) < threshold:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    # order by hash, then by place: the leftmost of equal ones wins
    place = np.arange(len(hashes), dtype=np.uint64)
    best = window_minima((hashes >> np.uint64(24) << np.uint64(24)) | place, threshold - GRAM + 1)
    place_of = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(place_of) + 1, np.int64)          # starts whose string stays inside its text
    fits = ends - begins >= threshold
    np.add.at(whole, begins[fits], 1)
    np.add.at(whole, (ends - threshold + 1)[fits], -1)
    starts = np.flatnonzero(np.cumsum(whole)[:-1] > 0)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = place_of[starts]
    text = np.searchsorted(ends, starts, "right")
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1) | (np.diff(text) != 0)) + 1
    first = np.concatenate([[0], new])
    count = np.diff(np.concatenate([first, [len(starts)]]))
    return starts[first], count, at[first], hashes[at[first]]


def _pieces(batch_rows, threshold):
    """Groups of (uid, base, bytes) of about GROUP bytes, or one part; long texts in overlapping parts."""
    group, size = [], 0
    for uid, text in batch_rows:
        data = (text or "").encode("utf-8", "surrogatepass")
        for base in range(0, max(1, len(data) - threshold + 1), PART):
            part = data[base:base + PART + threshold - 1]
            if len(part) >= threshold:
                if group and size + len(part) > GROUP:
                    yield group
                    group, size = [], 0
                group.append((uid, base, part))
                size += len(part)
    if group:
        yield group


def find_runs(texts: DataFrame, threshold: int) -> DataFrame:
    """Pass 1 over (uid, text): runs with their digit and the hash of all they cover.

    Runs that repeat inside one text are counted there (``copies``) and stand
    as one row; what they cover is repeated for certain and comes as rows with a
    null digit.
    """

    def scan(batches):
        out = Chunks(RUN_SCHEMA)
        for batch in batches:
            for group in _pieces(rows_of(batch, "uid", "text"), threshold):
                data = b"".join(part for _, _, part in group)
                ends = np.cumsum([len(part) for _, _, part in group])
                first, count, at, digit = runs_of(data, ends, threshold)
                which = np.searchsorted(ends, first, "right")
                begins = np.concatenate([[0], ends[:-1]])
                seed = ((at - first) << 10 | count).tolist()
                stop = (first + count - 1 + threshold).tolist()
                whole = np.array([xxhash.xxh3_64_intdigest(data[a:b], s) for a, b, s in
                                  zip(first.tolist(), stop, seed)], np.uint64)
                order = np.lexsort((whole, digit, which))
                same = ((np.diff(which[order]) == 0) & (np.diff(digit[order]) == 0) & (np.diff(whole[order]) == 0))
                leader = np.concatenate([[True], ~same])
                copies = np.diff(np.concatenate([np.flatnonzero(leader), [len(order)]]))
                for i, n in zip(order[leader].tolist(), copies.tolist()):
                    uid, base, _ = group[which[i]]
                    lo = int(first[i]) - int(begins[which[i]]) + base
                    anchor = int(at[i] - first[i]) + lo
                    yield from out.add((uid, lo, lo + int(count[i]) - 1 + threshold, anchor,
                                        _signed(int(digit[i])), _signed(int(whole[i])), n), 56)
                inside = np.repeat(copies, copies) > 1         # members of repeated runs
                for i in _merged(order[inside], which, first, stop):
                    uid, base, _ = group[which[i[0]]]
                    shift = base - int(begins[which[i[0]]])
                    yield from out.add((uid, i[1] + shift, i[2] + shift, None, None, None, None), 56)
        yield from out.rest()

    return texts.select("uid", "text").mapInArrow(frugal(scan), RUN_DDL)


def _merged(members: np.ndarray, which, first, stop):
    """(a run, start, end) of the joined covers of runs in the same text."""
    current = None
    for i in np.sort(members).tolist():
        if current and which[current[0]] == which[i] and first[i] <= current[2]:
            current[2] = max(current[2], stop[i])
        else:
            if current:
                yield current
            current = [i, int(first[i]), stop[i]]
    if current:
        yield current


def find_blocks(texts: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """Pass 2: blocks of the ``wanted`` runs (uid, runs: array of lo, hi, anchor, digit, open)."""
    core_bytes = threshold - BLOCK + 1

    def cut(batches):
        out = Chunks(BLOCK_SCHEMA)
        for batch in batches:
            for uid, text, runs in rows_of(batch, "uid", "text", "runs"):
                data = text.encode("utf-8", "surrogatepass")
                for run in runs:
                    anchor, n = run["anchor"], run["hi"] - run["lo"] - threshold + 1
                    far = anchor - run["lo"]                   # distances from start to anchor: far-n+1 .. far
                    near = far - n + 1
                    for i in range(near // BLOCK, far // BLOCK + 1):
                        a, b = max(near, i * BLOCK) - i * BLOCK, min(far, i * BLOCK + BLOCK - 1) - i * BLOCK
                        mid = anchor - i * BLOCK               # the core starts here
                        core = data[mid:mid + core_bytes]
                        left, right = data[mid - b:mid], data[mid + core_bytes:mid + threshold - a]
                        seed = (run["digit"] ^ (i + 1) * _BASE) & (1 << 64) - 1
                        yield from out.add(
                            (uid, mid - b, mid - a + threshold, a, b,
                             _signed(xxhash.xxh3_64_intdigest(core, seed)),
                             _signed(xxhash.xxh3_64_intdigest(left + b"|" + right, a << 8 | b)),
                             left, right, run["open"]), 150)
        yield from out.rest()

    # equal rows share a uid: one of them is enough to read the bytes from (the join has brought them together)
    one = texts.join(wanted, "uid").select("uid", "text", "runs").dropDuplicates(["uid"])
    return one.mapInArrow(frugal(cut), BLOCK_DDL)


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(uid, spans): covered bytes of each text as an array of (lo, hi); may overlap.

    ``docs``: uid (equal for equal rows) and text.
    """
    spark = docs.sparkSession
    found = written(find_runs(docs, threshold), "runs")
    runs, certain = found.where("digit is not null"), found.where("digit is null")
    # one row per distinct run, with how often it occurs and one place where it does
    distinct = runs.groupBy("digit", "whole").agg(
        F.sum("copies").alias("n"), F.min(F.struct("uid", "lo", "hi", "anchor")).alias("at"))
    digits = runs.groupBy("digit").agg(F.sum("copies").alias("total"), F.min("whole").alias("_a"),
                                       F.max("whole").alias("_b")).where("total > 1").select(
        "digit", (F.col("_a") != F.col("_b")).alias("mixed"))
    groups = written(distinct.join(digits, "digit"), "run_groups")
    release(spark)
    equal_runs = written(certain.select("uid", "lo", "hi").unionByName(
        runs.join(groups.where("n > 1").select("digit", "whole"), ["digit", "whole"], "left_semi")
        .select("uid", "lo", "hi")), "equal_runs")
    release(spark)
    # at most the runs of one text in one list
    wanted = (groups.where("mixed").select("at.*", "digit", (F.col("n") == 1).alias("open"))
              .groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "anchor", "digit", "open")).alias("runs")))
    blocks = written(find_blocks(docs, wanted, threshold), "blocks")
    release(spark)
    content = blocks.groupBy("core", "edges").agg(F.count("*").alias("n"))
    cores = content.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    states = written(content.join(cores, "core"), "block_groups")
    release(spark)
    # blocks that are repeated as a whole, and those whose core is shared by different edges
    placed = written(blocks.join(states.where("kinds > 1 or n > 1"), ["core", "edges"])
                     .where("kinds > 1 or (open and n > 1)"), "placed")
    release(spark)
    equal_blocks = placed.where("open and n > 1").select("uid", "lo", "hi")
    # pass 3: the strings of blocks whose core is shared by different edges
    t = F.explode(F.sequence("first", "last"))
    strings = (placed.where("kinds > 1").withColumn("t", t).select(
        "uid", "core", "edges", "open", "n", "t",
        (F.col("lo") + F.col("last") - F.col("t")).alias("lo"),
        F.expr("substring(left_bytes, length(left_bytes) - t + 1, t)").alias("l"),
        F.expr(f"substring(right_bytes, 1, {BLOCK - 1} - t)").alias("r")))
    key = ["core", "t", "l", "r"]
    shared = (strings.groupBy(*key).agg(F.min("edges").alias("_a"), F.max("edges").alias("_b"))
              .where("_a <> _b").select(*key))
    single = (strings.where("open and n = 1").join(shared, key, "left_semi")
              .select("uid", "lo", (F.col("lo") + threshold).alias("hi")))
    spans = equal_runs.unionByName(equal_blocks).unionByName(single)
    out = written(spans.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "spans")
    discard(found, groups, equal_runs, blocks, states, placed)
    release(spark)
    return out


RESULT_SCHEMA = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                           ("removed", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                           ("kept", pa.binary())])


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted (lo, hi); touching ones join."""
    out: list[list[int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def passages(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that are passages: over PASSAGE_WORDS words (parts of words count), or THRESHOLD bytes."""
    return [(lo, hi) for lo, hi in spans
            if hi - lo >= THRESHOLD or len(data[lo:hi].split()) > PASSAGE_WORDS]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of maximal runs."""
    parts, at = [], 0
    for lo, hi in spans:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def with_spans(docs: DataFrame, keep: tuple[str, ...], threshold: int, id_col: str, text_col: str) -> DataFrame:
    """``keep``, the text and its spans (null if it has none)."""
    uid = F.xxhash64(id_col, text_col)
    base = docs.select(*keep, *([] if text_col in keep else [text_col]), uid.alias("uid"))
    texts = docs.select(uid.alias("uid"), F.col(text_col).alias("text"))
    return base.join(repeated_spans(texts, threshold), "uid", "left")


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: int = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` + n_bytes, n_removed, n_spans, removed (spans), kept (bytes) of every text."""
    from pyspark.sql.pandas.types import to_arrow_type
    joined = with_spans(docs, keep, threshold, id_col, text_col)
    fields = [joined.schema[k] for k in keep]
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields] + list(RESULT_SCHEMA))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [
        "n_bytes bigint", "n_removed bigint", "n_spans bigint", "removed array<struct<lo:int,hi:int>>",
        "kept binary"])

    def cut(batches):
        out = Chunks(schema)
        for batch in batches:
            for *kept, text, found in rows_of(batch, *keep, text_col, "spans"):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = merge_spans((s["lo"], s["hi"]) for s in found or ())
                rest = without(data, spans)
                yield from out.add((*kept, len(data), len(data) - len(rest), len(spans),
                                    [{"lo": lo, "hi": hi} for lo, hi in spans], rest), 100 + 2 * len(rest))
        yield from out.rest()

    return joined.mapInArrow(frugal(cut), ddl)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs)
    text = F.col("kept").cast("string")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       # null where a removed run cuts a character, so that the rest is no text
                       F.when(F.is_valid_utf8(text), text).alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages (see ``passages``) removed from their texts.

    Bytes of characters that a removed run cuts are dropped with it; n_chars is
    counted anew; a null text stays null.
    """
    masked, names = masked_columns(docs)
    columns = list(names)
    id_col, text_col = names_of(names, "doc_id"), names_of(names, "text")
    counted = names_of(names, "n_chars") if "n_chars" in docs.columns else None
    joined = with_spans(masked, tuple(columns), PASSAGE_BYTES, id_col, text_col)

    def rest(old: str, found) -> str:
        data = old.encode("utf-8", "surrogatepass")
        spans = passages(data, merge_spans((s["lo"], s["hi"]) for s in found or ()))
        return without(data, spans).decode("utf-8", "ignore") if spans else old

    # the texts are cut here and not by ``remove_repeats``: a second function in the same tasks
    # would be a second Python worker beside each
    def text(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                cols = {n: part.column(part.schema.get_field_index(n)) for n in columns}
                new = [None if old is None else rest(old, found) for old, found in rows_of(part, text_col, "spans")]
                cols[text_col] = pa.array(new, pa.string())
                if counted:
                    kind = cols[counted].type
                    cols[counted] = pa.array([None if x is None else len(x) for x in new]).cast(kind)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return joined.select(*columns, "spans").mapInArrow(frugal(text), masked.schema).select(
        *[F.col(m).alias(c) for m, c in names.items()])


SQL = f"""
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n_bytes
           FROM documents),
w AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, {2 * THRESHOLD})) AS h
      FROM (SELECT doc_id, hx, unnest(range(n_bytes - {THRESHOLD - 1})) AS i FROM n WHERE n_bytes >= {THRESHOLD}) p),
d AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {THRESHOLD} THEN 0 ELSE 1 END AS f
      FROM d),
g AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
s AS (SELECT doc_id, min(i) AS lo, max(i) + {THRESHOLD} AS hi FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
k AS (SELECT doc_id, string_agg(substr(hx, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head,
             max(hi) AS stop, sum(hi - lo) AS removed, count(*) AS spans
      FROM p JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(rest) AS kept_sha256, TRY(decode(rest)) AS text
FROM (SELECT *, unhex(coalesce(head, '') || substr(hx, 2 * coalesce(stop, 0) + 1)) AS rest
      FROM n LEFT JOIN k USING (doc_id))
"""
