"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the n-grams of
one to three characters are hashed into a fixed number of features. A feature's
value is its share of the text's n-grams times its inverse document frequency,
which is counted over all training documents. The weights are trained with
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties), and a
temperature fitted on documents left out of that makes the scores probabilities.

The classifier itself is fitted on SAMPLE labelled documents at most, an equal
number of each language, chosen by a hash of doc_id; document frequencies and
predictions cover every document and its whole text.

Defined results: a null text, and one without letters, is ``und`` with score 0;
without any labelled training document all texts are. A null doc_id counts as an
empty one for the folds. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch
from .tokens import batches, release

#: Hashed features, as a power of two.
FEATURE_BITS = 16
#: Labelled documents that the classifier is fitted on, all languages together.
SAMPLE = 4000
#: Of these, one in so many is kept for the temperature.
CALIBRATION = 5
#: Follow-the-regularised-leader: step, smoothing, L1, L2, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 0.05, 3
SCALE = 20.0
#: Bytes of text that one pass works on.
SLICE = 1 << 20
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For n of 1, 2 and 3 the feature of the n-gram at each position; where each text's positions start and end; whether it has letters.

    A text's positions are those of a space before it and of its characters. Two
    more spaces follow it, so that no n-gram reaches into the next text.
    """
    rows = pc.utf8_lower(texts.fill_null("")).to_pylist()
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) + 1
    points = np.frombuffer("".join(f" {row}  " for row in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alpha = letters()[points]
    starts = np.cumsum(sizes + 2) - sizes - 2
    ends = starts + sizes
    there = np.concatenate([[0], np.cumsum(alpha)])
    some = there[ends] > there[starts]
    points = np.where(alpha, points, np.uint32(32))
    n = max(0, len(points) - 2)
    shift = np.uint32(32 - FEATURE_BITS)
    h, grams = np.zeros(n, dtype=np.uint32), []
    for k in range(3):
        h = (h + points[k : k + n] + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        grams.append((h * np.uint32(0x85EBCA6B)) >> shift)
    return grams, starts, ends, some


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, times the inverse document frequencies and the scale
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        grams, starts, ends, some = ngrams(texts)
        total = np.zeros((len(some), len(self.languages)))
        bounds = np.column_stack([starts, ends]).ravel()
        if len(bounds) and bounds[-1] == len(grams[0]):
            bounds = bounds[:-1]  # the last text ends where the positions do
        for gram in grams:
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.weights[k][gram], bounds)[::2] if len(some) else 0
        return total / (3 * (ends - starts))[:, None] + self.bias, some

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score; without a letter, or a model, UNKNOWN with score 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, some = self.logits(texts)
        p = softmax(logits / self.temperature)
        names = [self.languages[k] if s else UNKNOWN for k, s in zip(p.argmax(1).tolist(), some.tolist())]
        return names, np.where(some, p.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features + 1 for the bias, classes) by follow-the-regularised-leader with elastic-net penalties."""
    features = (1 << FEATURE_BITS) + 1
    z, n = np.zeros((features, classes)), np.zeros((features, classes))
    order = np.random.default_rng(seed)

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) > L1, w, 0.0)

    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = weights(at)
            p = softmax((x @ w)[None, :])[0]
            p[labels[k]] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(features))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out():
    """The fold that is never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def bucket_of(draw: Column) -> Column:
    """A draw's bucket: 64 of them between a number and its double, so the smallest draws of any number of rows are told apart."""
    return F.floor(F.log2(draw.cast("double") + 1) * 64).cast("int")


def last_buckets(learn: DataFrame, each: int) -> dict[str, int]:
    """For each language the last bucket of draws up to which it has no more than ``each`` rows (the first one at least)."""
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in learn.groupBy("lang", bucket_of(F.col("draw")).alias("b")).count().collect():  # some thousand a language at most
        counts.setdefault(r["lang"], []).append((r["b"], r["count"]))
    last = {}
    for lang, rows in counts.items():
        rows.sort()
        sums = np.cumsum([n for _, n in rows])
        last[lang] = rows[max(0, int(np.searchsorted(sums, each, "right")) - 1)][0]
    return last


def train(scratch: Scratch, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the training documents' text and lang alone."""
    learn = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text").withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    languages = [r[0] for r in learn.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([], np.zeros((0, 1 << FEATURE_BITS), np.float32), np.zeros(0))
    each = max(2, sample // len(languages))
    top = F.create_map(*[F.lit(v) for pair in last_buckets(learn, each).items() for v in pair])

    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << FEATURE_BITS
        frequency, flags, docs_seen = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int8), 0
        taken = set()  # draws of this task's part of the sample: a repeated row is taken once

        def row(kind, lang, draw, at, values):
            return pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([lang], pa.string()), pa.array([draw], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.int64()))],
                names=["kind", "lang", "draw", "at", "n"],
            )

        for batch in batches(incoming, SLICE):
            grams, starts, ends, some = ngrams(batch.column("text"))
            chosen = batch.column("chosen").to_pylist()
            for k in np.flatnonzero(some):
                a, b = starts[k], ends[k]
                for gram in grams:
                    flags[gram[a:b]] = 1
                frequency += flags
                flags[:] = 0
                docs_seen += 1
                if chosen[k] and (lang := batch.column("lang")[int(k)].as_py(), draw := batch.column("draw")[int(k)].as_py()) not in taken:
                    taken.add((lang, draw))
                    tf = sum(np.bincount(gram[a:b], minlength=size) for gram in grams)
                    at = np.flatnonzero(tf)
                    yield row(1, lang, draw, at.astype(np.int32), tf[at])
        if docs_seen:
            at = np.flatnonzero(frequency)
            yield row(0, None, None, at.astype(np.int32), frequency[at])
            yield row(2, None, None, [], [docs_seen])

    chosen = bucket_of(F.col("draw")) <= top[F.col("lang")]
    counted = learn.select("lang", "text", "draw", chosen.alias("chosen")).mapInArrow(count, "kind int, lang string, draw long, at array<int>, n array<long>")
    counted = scratch.write(counted, "counted")
    total = counted.where("kind = 2").agg(F.sum(F.col("n")[0])).first()[0] or 0
    frequency = np.zeros(1 << FEATURE_BITS)
    pairs = counted.where("kind = 0").select(F.explode(F.arrays_zip("at", "n")).alias("p")).groupBy("p.at").agg(F.sum("p.n").alias("df"))
    for at, df in pairs.collect():  # one row for each of the hashed features
        frequency[at] = df
    idf = np.log((1 + total) / (1 + frequency)) + 1
    rows, labels = [], []
    sampled = counted.where("kind = 1").dropDuplicates(["lang", "draw"]).orderBy("lang", "draw")
    for r in sampled.toLocalIterator():
        at, n = np.asarray(r["at"], dtype=np.int64), np.asarray(r["n"], dtype=float)
        x = SCALE * n / n.sum() * idf[at]
        rows.append((np.append(at, 1 << FEATURE_BITS), np.append(x, 1.0)))
        labels.append(languages.index(r["lang"]))
    labels = np.array(labels, dtype=np.int64)
    apart = np.arange(len(rows)) % CALIBRATION == 0
    w, bias = fit_ftrl([rows[k] for k in np.flatnonzero(~apart)], labels[~apart], len(languages))
    whole = np.vstack([w, bias])
    logits = np.array([x @ whole[at] for at, x in (rows[k] for k in np.flatnonzero(apart))]).reshape(-1, len(languages))
    rows.clear()
    release()  # the driver goes on with other work
    temperature = fit_temperature(logits, labels[apart])
    return Model(languages, np.ascontiguousarray((SCALE * idf[:, None] * w).T.astype(np.float32)), bias, temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, and after them lang_pred and score."""
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def guess(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(incoming, SLICE):
            found, scores = model.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(guess, schema)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(Scratch(docs.sparkSession, "language-id"), docs, sample)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows whose text has a language with at least this score; all columns stay, whatever their names.

    Where nothing can be learnt, as no training document has a label, nothing can be
    told of any row and all of them stay.
    """
    model = train(Scratch(docs.sparkSession, "language-id"), docs, sample)
    if not model.languages:
        return docs

    def choose(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(incoming, SLICE):
            _, scores = model.judge(batch.column("text"))
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(choose, docs.schema)
