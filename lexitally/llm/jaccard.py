"""N-gram Jaccard join by T-occurrence search (operator 5).

Two documents link when their sets of word shingles have a Jaccard similarity of
at least ``similarity``.  A document then has to share T shingles with a partner,
and an inverted list per shingle turns the join into a search for documents that
occur on T lists.  As DivideSkip does, lists are divided: a partner that occurs
on T lists occurs on one of the ``n - T + 1`` shortest, so only those are merged
for candidates, and the long ones are only probed for candidates already found.

1. Equal sets form classes (by hash of the set); the rest works on classes.
2. A sample of the hash space first (a fixed quarter of all shingles; documents
   whose share of it is too small to decide post all): a class with so many
   shingles of its own that T can't be reached is done.  Counting shingles is
   one aggregate with partial counts.
3. Whole sets of the classes that are left: shingles are ordered by the length of
   their list, and only a class's short lists are kept, as above.
4. Rounds over the lists: each list picks hubs (one, then 16, 256, ...), its
   other members are searched for them, links merge components (in full at the end, by one
   step in each round), and a list ends when its members are one component or all have been hubs.
   Two exact bounds spare most searches of members that link with nobody.  By place: all lists have
   one order, by length, so what precedes the first list that two classes share is shared by neither, and
   what follows it bounds the overlap.  By signature: each class folds its shingles into 1024 bits by
   parity; two signatures differ in no more bits than the sets differ in shingles.  So a list of
   thousands of near copies costs about its length and its links, and still no pair of different
   components that could link stays unsearched.
5. A search: the lists of a hub's shingles over a bounded cell of candidates; the
   short ones are merged by a heap, the T - 1 longest probed by binary search.

Defined results: without words, or with a null text, the set is empty and the
document is linked with nothing (its component is itself); fewer words than a
shingle has make one shingle of all of them; repeated rows are copies of each
other; a null doc_id takes part, but is no component's id unless alone.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunks, ascii_words, discard, frugal, mix64, release, rows_of, written

WORDS = 5
PERCENT = 80                      # least similarity, in hundredths
SHARE = 4                         # one in so many shingles is posted in the first pass
CACHE_WORDS = 1 << 18
CELL = 256                        # candidates searched for one hub at a time
SIGNATURE = 16                    # 64-bit words of a class's signature
# Multipliers of the places in a shingle: odd constants of the 64-bit golden ratio and of public mixers.
PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles of a whole text."""
    # bytes.lower changes A-Z only
    words = [w.lower() for w in ascii_words(text)] if text else []
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WORDS:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole >> 1], np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i, place in enumerate(PLACES):
        total += mix64(h[i:i + n] * place)
    return np.unique(mix64(total) >> np.uint64(1)).astype(np.int64)


def class_of(s: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(s.tobytes())
    return x - (1 << 64) if x >> 63 else x


def signature(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of 64 * SIGNATURE bits, as 64-bit words."""
    odd = np.bincount(s % (64 * SIGNATURE), minlength=64 * SIGNATURE).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def required(n: int, m: int) -> int:
    """Least overlap of sets of n and m members that link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


DIGEST = "xxhash64(text) AS digest"               # tells texts under one id, or under none, apart
SKETCH_DDL = "doc_id bigint, digest bigint, n bigint, cls bigint, posted bigint, whole boolean, keys array<bigint>"
SKETCH_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()),
                           ("posted", pa.int64()), ("whole", pa.bool_()), ("keys", pa.list_(pa.int64()))])


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: set size, class, and the shingles posted in the first pass.

    Sampled shingles keep their hash (not negative).  A document whose sample
    cannot decide also posts its whole set, as negative keys.
    """
    limit = (1 << 63) // SHARE

    def scan(batches):
        hashes, out = _Hashes(), Chunks(SKETCH_SCHEMA)
        for batch in batches:
            for doc, digest, text in rows_of(batch, "doc_id", "digest", "text"):
                s = shingles(text, hashes)
                if not len(s):
                    yield from out.add((doc, digest, 0, None, 0, False, []))
                    continue
                part = s[:np.searchsorted(s, limit)]
                whole = len(part) <= len(s) - -(-PERCENT * len(s) // 100)
                keys = np.concatenate([part, -1 - s]) if whole else part
                yield from out.add((doc, digest, len(s), class_of(s), len(part), whole, keys), 64 + 8 * len(keys))
        yield from out.rest()

    return docs.selectExpr("doc_id", DIGEST, "text").mapInArrow(frugal(scan), SKETCH_DDL)


def least(n):
    """T against any partner, as a column: the overlap is at least this share of n."""
    return F.ceil(n * PERCENT / 100).cast("bigint")


def promising(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes (rep, digest, cls) that may have a partner, judged by the posted shingles.

    With b posted of n shingles, a partner shares at least T - (n - b) of the
    posted ones; so a class with more than b - T + (n - b) posted shingles of its
    own has none.
    """
    posts = sketch.select("cls", F.explode("keys").alias("key"))
    counts = posts.groupBy("key").agg(F.count("*").alias("found")).where("found > 1")
    # counts grow with the corpus: merged at every size, never sent to all
    hits = posts.join(counts.hint("merge"), "key").groupBy("cls", "found", (F.col("key") < 0).alias("second")).agg(
        F.count("*").alias("hits"))
    # a class's own copies find its shingles, too: only more than those count
    shared = (hits.join(classes, "cls").where(F.col("found") > F.col("copies"))
              .groupBy("cls").agg(*[F.first(c).alias(c) for c in ("rep", "digest", "n", "posted", "whole")],
                                  F.sum(F.when(~F.col("second"), F.col("hits") / F.col("copies"))).alias("a"),
                                  F.sum(F.when(F.col("second"), F.col("hits") / F.col("copies"))).alias("b")))
    spare = F.col("n") - least(F.col("n"))
    first = F.coalesce(F.col("a"), F.lit(0.0)) + spare >= F.col("posted")
    second = F.coalesce(F.col("b"), F.lit(0.0)) >= least(F.col("n"))
    sampled = F.col("a").isNotNull() & F.when(F.col("whole"), F.lit(True)).otherwise(first)
    return shared.where(sampled | second).select("rep", "digest", "cls")


SET_DDL = "cls bigint, n bigint, members array<bigint>, bits array<bigint>"
SET_SCHEMA = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64())),
                        ("bits", pa.list_(pa.int64()))])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, members, bits) of the wanted classes, from their representatives' texts."""

    def scan(batches):
        hashes, out = _Hashes(), Chunks(SET_SCHEMA)
        for batch in batches:
            for text, cls in rows_of(batch, "text", "cls"):
                s = shingles(text, hashes)
                if class_of(s) == cls:                  # ids that repeat with another text don't count
                    yield from out.add((cls, len(s), s, signature(s)), 64 + 8 * (len(s) + SIGNATURE))
        yield from out.rest()

    on = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("t.digest") == F.col("w.digest"))
    return (docs.selectExpr("doc_id", DIGEST, "text").alias("t").join(wanted.hint("merge").alias("w"), on)
            .select("text", "cls").mapInArrow(frugal(scan), SET_DDL))


def short_lists(sets: DataFrame) -> DataFrame:
    """(key, cls, n, place): every class on its n - T + 1 shortest lists, without lists of one class.

    The place counts the class's shingles with shorter lists; equal lengths go by the shingle.
    """
    posts = sets.select("cls", F.explode("members").alias("key"))
    lengths = posts.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    # one list of a class's own shingles
    own = (posts.join(lengths.hint("merge"), "key").groupBy("cls")
           .agg(F.array_sort(F.collect_set(F.struct("length", "key"))).alias("found")))
    sized = own.join(sets.select("cls", "n").distinct(), "cls")
    # shingles found once are its shortest lists and hold nobody else
    alone = F.col("n") - F.size("found")
    keep = F.col("n") - least(F.col("n")) + 1 - alone
    lists = (sized.where(keep > 0)
             .select("cls", "n", alone.alias("alone"),
                     F.posexplode(F.slice("found", F.lit(1), keep.cast("int"))).alias("at", "f"))
             .select(F.col("f.key").alias("key"), "cls", "n", (F.col("alone") + F.col("at")).alias("place")))
    shared = lists.groupBy("key").agg(F.min("cls").alias("_a"), F.max("cls").alias("_b")).where("_a <> _b")
    return lists.join(shared.select("key"), "key", "left_semi")


# ---------------------------------------------------------------- the search
def t_occurrence(lists: list[list[int]], need: int, longest: int) -> dict[int, int]:
    """Members found on at least ``need`` of the sorted ``lists``, with how often.

    The ``longest`` lists (fewer than ``need``) are set aside; the others are
    merged by a heap, and members found often enough there to still reach
    ``need`` are probed for in the long ones by binary search.
    """
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    cut = len(lists) - min(longest, max(0, need - 1), len(lists))
    short, long = [lists[i] for i in order[:cut]], [lists[i] for i in order[cut:]]
    out: dict[int, int] = {}
    count, current = 0, None

    def done(member, count):
        if count < need - len(long):
            return
        for k, probe in enumerate(long):
            at = bisect_left(probe, member)
            count += at < len(probe) and probe[at] == member
            if count + len(long) - k - 1 < need:
                return
        out[member] = count

    for member in heapq.merge(*short):
        if member != current:
            if current is not None:
                done(current, count)
            current, count = member, 0
        count += 1
    if current is not None:
        done(current, count)
    return out


def inverted(query: np.ndarray, candidates: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the query, candidate) of every shingle of the query that a candidate holds."""
    at = np.concatenate([np.searchsorted(query, c) for c in candidates])
    member = np.concatenate(candidates)
    who = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    hit = (at < len(query)) & (query[np.minimum(at, len(query) - 1)] == member)
    order = np.argsort(at[hit], kind="stable")
    return at[hit][order], who[hit][order]


def search(query: np.ndarray, candidates: list[np.ndarray]) -> list[int]:
    """Indexes of the candidates that link with the query set."""
    if not candidates:
        return []
    sizes = [len(c) for c in candidates]
    need = min(required(len(query), n) for n in sizes)
    at, who = inverted(query, candidates)
    lists = [x.tolist() for x in np.split(who, np.flatnonzero(np.diff(at)) + 1)] if len(at) else []
    found = t_occurrence(lists, need, need - 1 - need // 8)
    return sorted(i for i, n in found.items() if n >= required(len(query), sizes[i]))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs (hub, cls) that link.

    Candidates of a hub come in cells of a bounded size; a hub's set is sent to each of its cells.
    """
    cells = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CELL).cast("bigint").alias("cells"))
    placed = (pairs.join(cells, "hub")
              .select("hub", "cls", F.pmod(F.col("cls"), F.col("cells")).alias("cell")))
    cands = placed.join(sets.select("cls", "members"), "cls").select("hub", "cell", "cls", "members")
    hubs = (placed.select("hub", "cell").distinct()
            .join(sets.select(F.col("cls").alias("hub"), F.col("members").alias("own")), "hub")
            .select(F.col("hub").alias("h"), F.col("cell").alias("k"), "own"))

    def cell(key, c: pa.Table, h: pa.Table) -> pa.Table:
        found: list[int] = []
        if len(c) and len(h):
            classes = c.column("cls").to_pylist()
            members = [np.asarray(x.values) for chunk in c.column("members").chunks for x in chunk]
            found = [classes[i] for i in search(np.asarray(h.column("own")[0].values), members)]
        return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return (cands.groupBy("hub", "cell").cogroup(hubs.groupBy("h", "k"))
            .applyInArrow(cell, "a bigint, b bigint"))


# ------------------------------------------------------------- components
def merge_components(labels: DataFrame, found: DataFrame) -> DataFrame:
    """New (cls, comp) after the links (a, b): the smallest component reachable.

    Every component takes its smallest neighbour, then labels jump to their
    label's label, until no edge joins different labels; the number of rounds
    grows with the logarithm of the longest chain.
    """
    edges = written(_edges(found, labels).distinct(), "edges")
    nodes = written(edges.select("x").union(edges.select("y")).distinct()
                    .select(F.col("x").alias("node"), F.col("x").alias("root")), "roots")
    while not edges.isEmpty():
        both = edges.select("x", "y").union(edges.select("y", "x"))
        hooks = both.groupBy("x").agg(F.min("y").alias("y")).where("y < x")
        nodes = _flatten(written(nodes.join(hooks.select(F.col("x").alias("root"), "y"), "root", "left")
                                 .select("node", F.coalesce("y", "root").alias("root")), "roots"))
        # what is left joins roots, and only roots may still be hooked
        edges = written(edges.join(nodes.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x")
                        .join(nodes.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
                        .where("rx <> ry").select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct(), "edges")
        release(labels.sparkSession)
    return labels.join(nodes.select(F.col("node").alias("comp"), "root"), "comp", "left").select(
        "cls", F.coalesce("root", "comp").alias("comp"))


def _flatten(nodes: DataFrame) -> DataFrame:
    """Every node points to the end of its chain of roots."""
    while True:
        parent = nodes.select(F.col("node").alias("root"), F.col("root").alias("up"))
        up = written(nodes.join(parent, "root", "left").select(
            "node", F.coalesce("up", "root").alias("root"), (F.col("up") < F.col("root")).alias("moved")), "roots")
        nodes = up.select("node", "root")
        if up.where("moved").isEmpty():
            return nodes


def _edges(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between classes as edges (x, y) between different components."""
    return (found.join(labels.select(F.col("cls").alias("a"), F.col("comp").alias("x")), "a")
            .join(labels.select(F.col("cls").alias("b"), F.col("comp").alias("y")), "b")
            .where("x <> y").select("x", "y"))


def take_smallest(labels: DataFrame, found: DataFrame) -> DataFrame:
    """One step of merging: each component takes its smallest linked one's label.

    Merges a star around a hub at once; longer chains are left for later steps.
    """
    edges = _edges(found, labels)
    low = (edges.select("x", "y").union(edges.select("y", "x")).groupBy("x").agg(F.min("y").alias("y"))
           .where("y < x").select(F.col("x").alias("comp"), "y"))
    return labels.join(low, "comp", "left").select("cls", F.coalesce("y", "comp").alias("comp"))


def components(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, comp) of all classes on the lists, by rounds of hubs (see the module)."""
    lists = written(lists, "lists")
    labels = written(lists.select("cls").distinct().select("cls", F.col("cls").alias("comp")), "labels")
    tested, all_links, width = None, None, 1
    kept, read = [], [lists]                   # tables to delete: at the end, once the next round has read them
    while True:
        live = lists.join(labels, "cls")
        mixed = live.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"),
                                        F.count("*").alias("size")).where("_a <> _b")
        live = written(live.join(mixed.select("key", "size"), "key").select("key", "cls", "n", "place", "comp", "size"),
                       "live")
        discard(*read)
        release(lists.sparkSession)            # each round's plans and broadcasts stay in the driver otherwise
        if live.isEmpty():
            break
        # a short list ends with all members as hubs, a long one picks the smallest class of each residue
        slot = F.when(F.col("size") <= 2 * width, F.col("cls")).otherwise(F.pmod("cls", F.lit(width)))
        picked = live.groupBy("key", slot).agg(F.min(F.struct("cls", "comp", "n", "place")).alias("h"))
        hubs = written(picked.select("key", F.col("h.cls").alias("hub"), F.col("h.comp").alias("hub_comp"),
                                     F.col("h.n").alias("hub_n"), F.col("h.place").alias("hub_place")), "hubs")
        # sets of too different sizes can't link, nor sets with too little after the first list they share
        alike = 100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n")
        enough = ((100 + PERCENT) * F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place"))
                  >= PERCENT * (F.col("n") + F.col("hub_n")))
        met_on = (F.col("l.key") == F.col("h.key")) & (F.col("l.comp") != F.col("h.hub_comp")) & alike & enough
        members, found_by = live, hubs
        if all_links is not None:
            # few lists are left: a pair meets on the first list that both are still on, not on each
            shared = (live.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("place", "key"))).alias("on"))
                      .select("cls", F.col("on.key").alias("keys"))
                      .join(sets.select("cls", "bits").dropDuplicates(["cls"]), "cls"))
            members = live.join(shared, "cls")
            found_by = hubs.join(shared.select(F.col("cls").alias("hub"), F.col("keys").alias("hub_keys"),
                                               F.col("bits").alias("hub_bits")), "hub")
            met_on = (met_on & similar_signatures()
                      & (F.col("l.key") == F.element_at(F.array_intersect("keys", "hub_keys"), 1)))
        met = members.alias("l").join(found_by.alias("h"), met_on)
        # the smaller class searches for the larger one, whichever is the hub
        pairs = met.select(F.least("hub", "cls").alias("hub"), F.greatest("hub", "cls").alias("cls")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["hub", "cls"], "left_anti")
        pairs = written(pairs, "pairs")
        found, old = written(links(pairs, sets), "links"), labels
        labels = written(take_smallest(old, found), "labels")
        tested = pairs if tested is None else tested.union(pairs)
        all_links = found if all_links is None else all_links.union(found)
        lists = live.join(hubs.select("key", F.col("hub").alias("cls")), ["key", "cls"], "left_anti").select(
            "key", "cls", "n", "place")
        kept += [pairs, found]
        read = [live, hubs, old]
        width *= 16
    if all_links is None:
        return labels
    done = written(merge_components(labels, all_links), "labels")
    discard(live, labels, *kept)
    return done


def similar_signatures():
    """Condition on bits, hub_bits, n, hub_n: no more bits differ than shingles may."""
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("hub_bits")[i])) for i in range(SIGNATURE)), F.lit(0))
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n") + F.col("hub_n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (see the module)."""
    spark = docs.sparkSession
    sketch = written(sketches(docs), "sketches")
    classes = written(sketch.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.coalesce(F.min_by("digest", "doc_id"), F.first("digest")).alias("digest"),
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "posted", "whole")]), "classes")
    wanted = written(promising(sketch, classes), "promising")
    release(spark)
    members = written(sketch.select("doc_id", F.col("n").alias("n_shingles"), "cls"), "members")
    sets = written(sets_of(docs, wanted), "sets")
    discard(sketch, wanted)
    release(spark)
    labels = components(short_lists(sets), sets)
    discard(sets)
    named = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = written(named, "named")
    ids = named.groupBy("comp").agg(F.min("rep").alias("smallest"))
    of = named.join(ids, "comp").select("cls", "smallest")
    return (members.join(of, "cls", "left")
            .select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id")))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Rows that repeat this doc_id and its text stay once, other texts under it stay, too; rows
    without a doc_id all stay.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM t),
n AS (SELECT t.doc_id, count(s.g) AS n_shingles FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
      WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, min(reached) AS component_id
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL
"""
