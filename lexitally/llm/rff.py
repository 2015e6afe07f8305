"""Quality classifier on random Fourier features (operator 10).

Statistics of the whole text (sizes, character classes, repetition) are
standardised and mapped to random cosine features that approximate a Gaussian
kernel.  Ridge regression on them needs only the normal equations, which each
partition sums up for its own rows; the sums are added up in two steps.  An
isotonic fit on counts in fixed score bins turns the ridge score into a
probability.  All labelled documents that are not held out take part: four
fifths fit the ridge, one fifth calibrates.

Defined results: null and empty texts have all-zero statistics and get a score
like any other; labels of unknown documents and null labels are ignored;
repeated labels count as often as they occur; without any label every score is
0.5; repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunks, discard, frugal, rows_of, split_key, table, written

FEATURES = ("log_chars", "log_words", "word_length", "symbols", "marks", "upper", "digits", "letters",
            "blanks", "distinct_words", "repeat_pairs", "repeat_lines", "top_word", "plain_words",
            "line_length", "entropy", "capital_words", "ended_words", "pipes")
DIM = 192
RIDGE = 1e-3
BINS = 400
LOW, HIGH = -0.5, 1.5


def _classes() -> dict[str, np.ndarray]:
    sets = {"symbols": b"#*$%&|<>{}[]\\^~@=+", "marks": b"!?", "digits": b"0123456789", "pipes": b"|",
            "upper": bytes(range(65, 91)), "letters": bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xE0)]),
            "blanks": b" \t\n\r\x0b\x0c"}
    out = {}
    for name, members in sets.items():
        out[name] = np.zeros(256)
        out[name][list(members)] = 1
    return out


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one whole text; zeros for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = {k: float(hist @ v) / n for k, v in CLASSES.items()}
    p = hist[hist > 0] / n
    words = data.split()
    nw = max(1, len(words))
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    np_ = max(1, len(words) - 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    nl = max(1, len(lines))
    plain = sum(c for w, c in seen.items() if w.isalpha() or not w.isascii())
    capital = sum(c for w, c in seen.items() if 65 <= w[0] <= 90 or w[:1] == b"\xc3" and 128 <= w[1] <= 158)
    ended = sum(c for w, c in seen.items() if w[-1] in b".,;:!?")
    return [np.log1p(n), np.log1p(len(words)), np.log1p(sum(map(len, words)) / nw), share["symbols"], share["marks"],
            share["upper"], share["digits"], share["letters"], share["blanks"],
            len(seen) / nw, 1 - len(pairs) / np_ if len(words) > 1 else 0.0, 1 - len(set(lines)) / nl,
            (max(seen.values()) / nw) if seen else 0.0, plain / nw, np.log1p(n / nl),
            float(-(p * np.log2(p)).sum()), capital / nw, ended / nw, share["pipes"]]


STATS_DDL = "doc_id bigint, stats binary"
STATS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("stats", pa.binary())])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): packed float64 statistics of every whole text."""

    def measure(batches):
        out = Chunks(STATS_SCHEMA)
        for batch in batches:
            for doc, text in rows_of(batch, "doc_id", "text"):
                yield from out.add((doc, np.array(statistics(text)).tobytes()), 200)
        yield from out.rest()

    return docs.select("doc_id", "text").mapInArrow(frugal(measure), STATS_DDL)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(FEATURES))


def _sum_partitions(df: DataFrame, arrays, width: int) -> np.ndarray:
    """Sum what ``arrays(batch)`` gives over all batches: in each partition, then in
    groups of partitions, then over those groups (at most 16 rows to the driver)."""

    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            total += arrays(batch)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    def add(batches):
        total = np.zeros(width)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    sums = (df.mapInArrow(frugal(partial), "v binary").repartition(16)
            .mapInArrow(add, "v binary").collect())
    return np.sum([np.frombuffer(r["v"]) for r in sums], axis=0)


class Model:
    """Standardisation, random features, ridge weights and the isotonic table."""

    def __init__(self, mean, scale, seed: int = 11):
        rng = np.random.default_rng(seed)
        k = len(FEATURES)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(0, 1 / np.sqrt(k), (k, DIM))
        self.phase = rng.uniform(0, 2 * np.pi, DIM)
        self.weights = np.zeros(DIM + 1)
        self.grid, self.prob = np.array([LOW, HIGH]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / DIM) * np.cos(x @ self.freq + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.grid, self.prob)


def isotonic(positives: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing shares of positives per bin with counts."""
    blocks: list[list[float]] = []
    for p, n in zip(positives, counts):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for p, n, k in blocks]) if blocks else np.array([])


def train(stats: DataFrame, labels: DataFrame, target: str = "quality") -> Model | None:
    """Fit on labelled rows that are not held out; ``stats`` must be a written table."""
    rows = (labels.where(F.col(target).isNotNull() & (split_key() != 1))
            .select("doc_id", F.col(target).cast("double").alias("y")).join(stats, "doc_id"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    rows = written(rows.select("y", "stats", (fold == 0).alias("calibrate")), "quality_rows")
    fit_rows, hold_rows = rows.where("not calibrate"), rows.where("calibrate")
    k = len(FEATURES)

    def moments(batch):
        x = _matrix(batch.column(1))
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = _sum_partitions(fit_rows.select("y", "stats"), moments, 1 + 2 * k)
    if not m[0]:
        return None
    mean = m[1:k + 1] / m[0]
    scale = np.sqrt(np.maximum(m[k + 1:] / m[0] - mean ** 2, 0)) + 1e-6
    model = Model(mean, scale)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d = DIM + 1

    def normal(batch):
        total = np.zeros(d * d + d)
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            z, y = shared.value.features(_matrix(part.column(1))), part.column(0).to_numpy()
            total[:d * d] += (z.T @ z).ravel()
            total[d * d:] += z.T @ y
        return total

    s = _sum_partitions(fit_rows.select("y", "stats"), normal, d * d + d)
    a = s[:d * d].reshape(d, d) / m[0]
    model.weights = np.linalg.solve(a + RIDGE / 100 * np.eye(d), s[d * d:] / m[0])
    fitted = rows.sparkSession.sparkContext.broadcast(model)

    def bins(batch):
        at = np.clip((fitted.value.raw(_matrix(batch.column(1))) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1)
        at = at.astype(np.int64)
        return np.concatenate([np.bincount(at, minlength=BINS),
                               np.bincount(at, batch.column(0).to_numpy(), minlength=BINS)])

    b = _sum_partitions(hold_rows.select("y", "stats"), bins, 2 * BINS)
    if not b.any():
        b = _sum_partitions(fit_rows.select("y", "stats"), bins, 2 * BINS)
    discard(rows)
    used = np.flatnonzero(b[:BINS])
    model.grid = LOW + (used + 0.5) * (HIGH - LOW) / BINS
    model.prob = isotonic(b[BINS:][used], b[:BINS][used])
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) for every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for batch in batches:
            x, model = _matrix(batch.column(1)), shared.value
            s = np.concatenate([model.score(x[i:i + 2048]) for i in range(0, len(x), 2048)]
                               or [np.zeros(0)]) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(frugal(apply), "doc_id bigint, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    stats = written(document_statistics(docs), "quality_stats")
    return score(stats, train(stats, labels, target))


def query(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).withColumn("held_out", split_key() == 1)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of good quality; others go.

    Verdicts come by doc_id; rows that share a doc_id are scored each and stay
    if one of them is good (ids are unique in the tables given).
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    good = classify(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["doc_id"]), "left_semi")
