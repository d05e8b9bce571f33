"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence scores ``sigmoid(bias + sum of its words'
weights)``, where a word weighs as itself and by its first four and five letters, and the bag is
toxic unless every sentence is clean (noisy-or). The weights are trained from document labels
only, through the noisy-or, and the same weights then point at the offending sentences: all that
score at least ``OFFENDS``, and in a document predicted toxic at least the top one.

Noisy-or alone would make every long document toxic, as each clean sentence leaks a little. So the
leak that as many clean sentences have (mean and ``SIGMAS`` standard errors, measured on the
training sample's clean documents) is taken off a document's evidence before it becomes a
score, and the scale of what remains is the one under which the training labels are likeliest.

Training reads at most ``SAMPLE`` labelled documents of at most ``SAMPLE_CHARS`` characters each,
taken in the order of a hash of their id among those whose crc32(doc_id as text) mod 5 is not 0;
scoring reads every document whole. Labels, lang, source and doc_id never enter a score.

Defined results: a null or empty text has no sentence and scores 0; without a usable label
every document scores 0; repeated rows score alike, and a null doc_id is not held out; where labels
repeat, the highest counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, table, texts_of

SAMPLE, SAMPLE_CHARS = 6000, 20_000
#: A feature needs this many training documents; of those more usual in toxic documents by at least
#: LEAST_Z standard errors, the clearest are kept.
LEAST_DOCS, LEAST_Z, MOST_FEATURES = 3, 2.0, 4000
STEPS, RATE, RIDGE = 150, 0.3, 0.01
MEMO = 200_000
#: A sentence of this score is offending.
OFFENDS = 0.5
#: A document of this score is predicted toxic.
TOXIC = 0.5
START_BIAS = -6.0
#: Standard errors of the clean leak that are taken off, and the scales tried for what remains.
SIGMAS = 3.0
SCALES = tuple(math.exp(k / 10) for k in range(-15, 16))

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def bag(text: str) -> list[list[str]]:
    """The distinct words of each sentence, in lower case."""
    low = text.lower()
    return [w for a, b in sentences(low) if (w := list(dict.fromkeys(_WORD.findall(low, a, b))))]


def features(word: str) -> tuple[str, ...]:
    """The word itself, and its openings of four and five letters."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) >= k))


class WordWeights(dict):
    """A word's weight over all its features, remembered."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> float:
        total = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 32:
            self[word] = total
        return total


@dataclass(frozen=True)
class Model:
    """``leak``: mean and variance of a clean sentence's evidence. An untrained model has the bias -inf."""

    words: WordWeights
    bias: float = -math.inf
    leak: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0

    def evidence(self, total: float, n: int) -> float:
        """What ``n`` sentences show together beyond the leak of as many clean ones."""
        return max(0.0, total - self.leak[0] * n - SIGMAS * math.sqrt(self.leak[1] * n))

    def probability(self, total: float, n: int) -> float:
        return -math.expm1(-self.scale * self.evidence(total, n))


def train(texts: list[str], labels: list[int]) -> Model:
    """Word weights and bias that maximise the noisy-or likelihood of the document labels."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(WordWeights({}))
    bags = [bag(t) for t in texts]
    with_, toxic_with = Counter(), Counter()
    for b, label in zip(bags, labels, strict=True):
        own = {f for w in {w for s in b for w in s} for f in features(w)}
        with_.update(own)
        if label:
            toxic_with.update(own)
    n1, n = y.sum(), len(y)
    ranked = []
    for f, k in with_.items():
        if k >= LEAST_DOCS and toxic_with[f]:
            spread = math.sqrt(k / n * max(1 - k / n, 1 / n) * (1 / n1 + 1 / (n - n1)))
            z = (toxic_with[f] / n1 - (k - toxic_with[f]) / (n - n1)) / spread
            if z >= LEAST_Z:
                ranked.append((-z, f))
    vocabulary = {f: k for k, (_, f) in enumerate(sorted(ranked)[:MOST_FEATURES])}
    doc, row, col, n = [], [], [], 0
    for d, b in enumerate(bags):
        for s in b:
            known = [vocabulary[f] for w in s for f in features(w) if f in vocabulary]
            row += [n] * len(known)
            col += known
            doc.append(d)
            n += 1
    doc, row, col = (np.array(x, np.int64) for x in (doc, row, col))
    weights, bias = np.zeros(len(vocabulary)), START_BIAS
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(row, weights[col], n), -30, 30)
        clean = -np.logaddexp(0, z)  # log(1 - p) of each sentence
        dirty = -np.expm1(np.minimum(np.bincount(doc, clean, len(y)), -1e-12))  # noisy-or of each document
        p = 1 / (1 + np.exp(-z))
        push = np.where(y == 1, (1 - dirty) / np.maximum(dirty, 1e-9), -1.0)[doc] * p
        g = np.bincount(col, push[row], len(weights)) / len(y) * 50 - RIDGE * weights
        gb = push.sum() / len(y)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        weights += RATE * (m / c1) / (np.sqrt(v / c2) + 1e-3)
        bias += 0.05 * (mb / c1) / (math.sqrt(vb / c2) + 1e-3)
    kept = np.abs(weights) > 1e-2
    z = np.clip(bias + np.bincount(row, (weights * kept)[col], n), -30, 30)
    part = np.logaddexp(0, z)
    clean = part[y[doc] == 0]
    leak = (float(clean.mean()), float(clean.var())) if len(clean) else (0.0, 0.0)
    model = Model(WordWeights({w: float(weights[k]) for w, k in vocabulary.items() if kept[k]}), float(bias), leak)
    sums, sizes = np.bincount(doc, part, len(y)), np.bincount(doc, minlength=len(y))
    shown = np.array([model.evidence(t, int(k)) for t, k in zip(sums, sizes, strict=True)])
    likelihood = [np.log(np.maximum(-np.expm1(-c * shown[y == 1]), 1e-6)).sum() - c * shown[y == 0].sum() for c in SCALES]
    return replace(model, scale=SCALES[int(np.argmax(likelihood))])


def score(text: str, model: Model) -> tuple[float, int, int, float, list[tuple[int, int, float]]]:
    """The document's score, the span and score of its most suspicious sentence, and all offending ones in order."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift the spans
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    bias = model.bias
    if bias == -math.inf:
        return 0.0, -1, -1, 0.0, []
    get, total, n, worst, offending = model.words.__getitem__, 0.0, 0, (-1, -1, -math.inf), []
    least = math.log(OFFENDS / (1 - OFFENDS))
    for m in _SENTENCE.finditer(low):
        words = set(_WORD.findall(m[0]))
        if words:
            z = bias + sum(map(get, words))
            total += math.log1p(math.exp(min(z, 30.0)))
            n += 1
            if z >= least:
                offending.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
            if z > worst[2]:
                worst = (m.start(), m.end(), z)
    a, b, z = worst
    found, top = model.probability(total, n), 1 / (1 + math.exp(-max(z, -700.0))) if a >= 0 else 0.0
    if found >= TOXIC and not offending:
        offending.append((a, b, top))
    return found, a, b, top, offending


def remainder(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the bounded sample. Only its ids, at most ``SAMPLE``, are broadcast, and at most as many
    rows reach the driver, however often an id is repeated."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fits = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = fits.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE).toArrow()
    return train(rows["text"].to_pylist(), [int(t > 0) for t in rows["toxic"].to_pylist()])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, the most suspicious sentence and all offending ones of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES features

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [score(t, shared.value) for t in texts_of(batch)]  # a worker keeps the model, and its words' weights
        cols = [batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64())]
        cols += [pa.array([int(f[0] >= TOXIC) for f in found], pa.int32())]
        cols += [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]
        cols += [pa.array([f[3] for f in found], pa.float64())]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        cols += [pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in f[4]] for f in found], pa.list_(span))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", "worst_start", "worst_end", "worst_score", "offending"])

    schema = (
        "doc_id bigint, score double, predicted int, worst_start bigint, worst_end bigint, worst_score double, "
        "offending array<struct<start: bigint, end: bigint, score: double>>"
    )
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), one, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(docs, labels))
    return out.withColumn("held_out", F.coalesce(remainder() == 0, F.lit(False)))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic: each row by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([score(t, shared.value)[0] < TOXIC for t in texts_of(batch)], pa.bool_()))

    return map_batches(docs, one, T.StructType(docs.schema.fields))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
