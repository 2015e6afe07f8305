"""Language identification with averaged subword embeddings (operator 4).

A text is the average of embeddings of hashed subwords: each word of letters
gives itself and its character 2- to 4-grams (with word edges), hashed into a
fixed number of buckets.  A linear softmax on the average gives the language.
Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample: at most ``sample`` labelled documents a language (a documented
bound), whole texts, plus short cuts of them so that texts of a few
words are learned too.  A temperature fitted on documents kept out of the
training calibrates the score.

The score is a share among the learned languages, so it cannot show that a text
is in none of them.  The evidence does: the mean log probability of a text's
subwords in the language it is given, against chance.  A text is accepted when
its score and its evidence are as high as those of clean texts of its length:
bounds are fitted by length class, the score's on documents kept out of the
training, the evidence's by language with each document's own subwords taken
out of the counts.  A language with fewer than ``MIN_CLASS`` calibration texts
(whole and cut) has no bound on the evidence.

The average is linear, so a word's share of the logits is computed once per
task and text cost is one table look-up per distinct word.

Defined results: a null text or one without a letter gives ``und``, score 0,
not accepted; with no labelled rows at all every text is ``und``; repeated rows
give repeated results; prediction depends on the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Chunks, frugal, keep_only, masked_columns, mix64, names_of, release, rows_of, split_key

BUCKETS = 1 << 15
DIM = 16
SAMPLE_PER_LANGUAGE = 500
MAX_LANGUAGES = 1000
CACHE_WORDS = 1 << 17
CACHE_BYTES = 64 << 20                  # of a task's word table, where there are many languages
LEARN_WORDS = 1 << 14                   # words looked up at once
CLASSES = (32, 128, 512)                # length classes: subwords of a text over the least count of one
MIN_CLASS = 30                          # a class with fewer calibration texts takes in the shorter ones
FENCE = 1.5                             # bounds: median - FENCE * (median - 0.1 % quantile)
SNIPPETS = (1, 2, 4, 9)                 # words in the short cuts of a training text
_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; numbers that are no digits (superscripts, fractions) are no letters."""
    text = text.lower()
    found = _RUNS(text)
    if all(map(str.isalpha, found)):
        return found
    return "".join([c if c.isalpha() else " " for c in text]).split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each word and its 2- to 4-grams with edges, all words at once."""
    edged = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(edged.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    numbers, buckets = [np.arange(len(words))], [whole]
    h = codes
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]
        inside = of[:len(h)] == of[n - 1:]                 # grams that do not cross into the next word
        numbers.append(of[:len(h)][inside])
        buckets.append(mix64(h[inside] + np.uint64(n)))
    return np.concatenate(numbers), (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bag(words: list[str] | Counter) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their shares) of a list of words."""
    counts = Counter(words)
    of, buckets = subwords(list(counts))
    times = np.fromiter(counts.values(), np.float64, len(counts))
    total = np.bincount(buckets, times[of], minlength=BUCKETS)
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), (total[idx] / total.sum()).astype(np.float32)


def training_bags(labelled: DataFrame) -> DataFrame:
    """(lang, doc_id, part, idx, share): whole texts (part 0) and short cuts."""
    schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("part", pa.int32()),
                        ("idx", pa.binary()), ("share", pa.binary())])

    def features(batches):
        out = Chunks(schema)
        for batch in batches:
            for doc, text, lang in rows_of(batch, "doc_id", "text", "lang"):
                words = words_of(text) if text else []
                cuts = [words]
                for k, n in enumerate(SNIPPETS):
                    at = zlib.crc32(f"{doc}/{k}".encode()) % max(1, len(words) - n + 1)
                    cuts.append(words[at:at + n])
                for part, cut in enumerate(cuts):
                    if cut:
                        idx, share = bag(cut)
                        yield from out.add((lang, doc, part, idx.tobytes(), share.tobytes()), 8 * len(idx))
        yield from out.rest()

    return labelled.select("doc_id", "text", "lang").mapInArrow(
        frugal(features), "lang string, doc_id bigint, part int, idx binary, share binary")


class Model:
    """Bucket logits (embeddings times softmax weights), bias, temperature; log probabilities
    of the buckets (against chance) and the bounds of score and evidence by length class."""

    def __init__(self, languages, logits, bias, temperature=1.0):
        self.languages, self.logits, self.bias = languages, logits, bias
        self.temperature = temperature
        self.log_odds = np.zeros_like(logits)
        self.least_logit = [(-np.inf, 0.0, 1.0)] * (len(CLASSES) + 1)
        self.least_evidence = [[(-np.inf, 0.0, 1.0)] * (len(CLASSES) + 1) for _ in languages]

    def accepts(self, language: int, score: float, evidence: float, length: float) -> bool:
        at = int(np.searchsorted(CLASSES, length, "right"))
        return (_logit(score) >= _bound(self.least_logit[at], length)
                and evidence >= _bound(self.least_evidence[language][at], length))

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model | None:
    """SGD over (lang, doc_id, part, idx, share); a fifth of the documents calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    k = len(languages)
    of = {name: i for i, name in enumerate(languages)}
    data = [(of[lang], np.frombuffer(idx, np.int32), np.frombuffer(share, np.float32),
             zlib.crc32(f"fold {doc}".encode()) % 5 == 0) for lang, doc, _, idx, share in sorted(
                 rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))]
    train = [d for d in data if not d[3]] or data
    hold = [d for d in data if d[3]] or data
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, k), np.float32)
    bias = np.zeros(k, np.float32)
    steps = epochs * len(train)
    for step in range(steps):
        if step % len(train) == 0:
            order = rng.permutation(len(train))
        y, idx, share, _ = train[order[step % len(train)]]
        lr = rate * (1 - step / steps)
        x = share @ emb[idx]
        z = x @ soft + bias
        e = np.exp(z - z.max())
        g = e / e.sum()
        g[y] -= 1
        back = soft @ g
        soft -= lr * np.outer(x, g)
        bias -= lr * 0.1 * g
        # shares of a long text are small: scale the step so that rare buckets move too
        emb[idx] -= lr * min(len(idx), 64) * share[:, None] * back
    model = Model(languages, emb @ soft, bias)
    _calibrate(model, hold)
    _fit_evidence(model, rows)
    return model


def _logit(p):
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def _length(share: np.ndarray) -> float:
    """Subwords of a text over the least count of one of them."""
    return 1 / float(share.min())


def _bound(fitted: tuple[float, float, float], length: float) -> float:
    """Least value for a text; shorter than all that calibrated it, its reach widens."""
    median, reach, shortest = fitted
    return median - reach * max(1.0, shortest / length) ** 0.5


def _bounds(values: np.ndarray, lengths: np.ndarray) -> list[tuple[float, float, float]]:
    """(median, reach, shortest length) for each length class; no bound without enough texts."""
    of = np.searchsorted(CLASSES, lengths, "right")
    out = []
    for c in range(len(CLASSES) + 1):
        # the class itself, with shorter ones (then longer ones) until there are enough
        low = next((i for i in range(c, -1, -1) if ((of >= i) & (of <= c)).sum() >= MIN_CLASS), 0)
        high = next((j for j in range(c, len(CLASSES) + 1) if ((of >= low) & (of <= j)).sum() >= MIN_CLASS), None)
        if high is None:
            out.append((-np.inf, 0.0, 1.0))
            continue
        inside = (of >= low) & (of <= high)
        x = np.sort(values[inside])
        median = float(np.median(x))
        out.append((median, FENCE * (median - float(x[len(x) // 1000])), float(lengths[inside].min())))
    return out


def _calibrate(model: Model, hold: list) -> None:
    """Temperature of least held-out log loss, then the bounds of the score's logit
    from the rightly named held-out texts."""
    z = np.array([share @ model.logits[idx] for _, idx, share, _ in hold]) + model.bias
    y = np.array([d[0] for d in hold])
    best = None
    for t in np.geomspace(0.05, 20, 61):
        model.temperature = t
        p = model.probabilities(z)[np.arange(len(y)), y]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, t)
    model.temperature = best[1]
    p = model.probabilities(z)
    right = p.argmax(axis=1) == y
    lengths = np.array([_length(share) for _, _, share, _ in hold])
    model.least_logit = _bounds(_logit(p.max(axis=1)[right]), lengths[right])


def _fit_evidence(model: Model, rows: list[tuple]) -> None:
    """Log probabilities of the buckets by language over all whole texts, and the bounds of the
    evidence: each rightly named text and cut is held against the counts without its own document."""
    documents: dict[tuple, list] = {}
    whole: dict[tuple, list] = {}
    for lang, doc, part, idx, share in rows:
        idx, share = np.frombuffer(idx, np.int32), np.frombuffer(share, np.float32)
        documents.setdefault((lang, doc), []).append((idx, share))
        if part == 0:
            whole.setdefault((lang, doc), []).append((idx, np.rint(share / share.min())))
    for at, lang in enumerate(model.languages):
        counts = np.zeros(BUCKETS)
        for key, texts in whole.items():
            if key[0] == lang:
                for idx, n in texts:
                    counts[idx] += n
        total, values, lengths = counts.sum(), [], []
        for key, parts in documents.items():
            if key[0] != lang:
                continue
            own = np.zeros(BUCKETS)
            for idx, n in whole.get(key, []):
                own[idx] += n
            rest = total - own.sum()
            for idx, share in parts:
                if int((share @ model.logits[idx] + model.bias).argmax()) != at:
                    continue                               # a cut in another language, or of none
                values.append(float(share @ _log_odds(counts[idx] - own[idx], rest)))
                lengths.append(_length(share))
        model.log_odds[:, at] = _log_odds(counts, total)
        model.least_evidence[at] = _bounds(np.array(values), np.array(lengths))


def _log_odds(counts: np.ndarray, total: float) -> np.ndarray:
    """Smoothed log probability of buckets, 0 for one that is as frequent as by chance."""
    return np.log((counts + 0.5) / (total + 0.5 * BUCKETS) * BUCKETS).astype(np.float32)


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on labelled documents that are not held out (crc32(doc_id) mod 3 is not 1).

    The sample is drawn by a hash of doc_id and text, which stands for the document from
    here on: ``sample`` different documents a language, or all if there are fewer, for
    null and repeated ids too; a document that occurs more than once is drawn once.
    """
    usable = docs.where((split_key() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.xxhash64("doc_id", "text").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different lang values")
    if not counts:
        return None
    # about twice as many as needed, each once, then the exact cut
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                           for x in (lang, int(min(1.0, 2 * sample / max(1, n)) * (1 << 30)))])
    drawn = usable.where(F.pmod("doc_id", F.lit(1 << 30)) < share[F.col("lang")])
    once = drawn.groupBy("lang", "doc_id").agg(F.first("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    rows = training_bags(once.withColumn("at", order).where(F.col("at") <= sample)).collect()
    model = fit([tuple(r) for r in rows])
    del rows
    release(docs.sparkSession)                 # the driver needs the sample no more
    return model


class _WordLogits(dict):
    """word -> row of a matrix of (summed logits, summed log odds, number of subwords)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.parts = np.hstack([model.logits, model.log_odds])
        width = self.parts.shape[1] + 1
        self.rows = np.zeros((max(LEARN_WORDS, min(CACHE_WORDS, CACHE_BYTES // (4 * width))), width), np.float32)

    def learn(self, words: list[str]) -> None:
        """Add the rows of words that are new."""
        new = [w for w in words if w not in self]
        if not new:
            return
        of, buckets = subwords(new)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(new)))
        at = len(self)
        self.rows[at:at + len(new), :-1] = np.add.reduceat(self.parts[buckets[order]], starts, axis=0)
        self.rows[at:at + len(new), -1] = np.bincount(of, minlength=len(new))
        self.update(zip(new, range(at, at + len(new))))


class Scorer:
    def __init__(self, model: Model | None):
        self.model = model
        self.words = _WordLogits(model) if model else None

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, calibrated score, accepted)."""
        counts = Counter(words_of(text)) if text and self.model else None
        if not counts:
            return "und", 0.0, False
        k = len(self.model.languages)
        words, total = list(counts), np.zeros(2 * k + 1)
        for start in range(0, len(words), LEARN_WORDS):
            part = words[start:start + LEARN_WORDS]
            if len(self.words) + len(part) > len(self.words.rows):
                self.words.clear()
            self.words.learn(part)
            at = np.fromiter(map(self.words.__getitem__, part), np.int64, len(part))
            n = np.fromiter((counts[w] for w in part), np.float64, len(part))
            total += n @ self.words.rows[at]
        means = total[:-1] / total[-1]
        p = self.model.probabilities(means[:k] + self.model.bias)
        best = int(p.argmax())
        accepted = self.model.accepts(best, p[best], means[k + best], total[-1] / min(counts.values()))
        return self.model.languages[best], float(p[best]), bool(accepted)


def identify(df: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",),
             text_col: str = "text") -> DataFrame:
    """``keep`` + lang_pred, score, accepted for every whole text.

    The model (buckets x languages floats) is broadcast: its size is fixed by
    BUCKETS and MAX_LANGUAGES, not by the data.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*keep, text_col) if text_col not in keep else df.select(*keep)
    fields = [src.schema[k] for k in keep]
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
                       + [("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                    + ["lang_pred string", "score double", "accepted boolean"])

    def predict(batches):
        keep_only("langid")
        scorer, out = Scorer(shared.value), Chunks(schema)
        for batch in batches:
            for *kept, text in rows_of(batch, *keep, text_col):
                size = 64 + (len(text) * 2 if text and text_col in keep else 0)
                yield from out.add((*kept, *scorer.score(text)), size)
        yield from out.rest()

    return src.mapInArrow(frugal(predict), ddl)


def query(spark, docs: DataFrame) -> DataFrame:
    scored = identify(docs, train(docs))
    return scored.withColumn("held_out", split_key() == 1)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; others go.  Further columns may have any name."""
    masked, names = masked_columns(docs)
    scored = identify(masked, train(docs), keep=tuple(names), text_col=names_of(names, "text"))
    return scored.where("accepted").select(*[F.col(m).alias(c) for m, c in names.items()])
