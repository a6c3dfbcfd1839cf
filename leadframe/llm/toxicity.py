"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and an L1 penalty leave few weights that are not zero, a table small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashCache, documents, mix64, plain_words, small_parts, tidied
from .langid import held_out

BITS = 20
THRESHOLD = 0.3
#: The training sample holds about so many labelled documents of each label, chosen by a hash of doc_id.
SAMPLE_DOCS = 3000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def word_hashes(words: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(w) for w in words]


def features(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates of a text with word hashes h, repeats included: words, pairs of neighbours, and pairs with one word between."""
    parts = [h]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(mix64(h[:-gap] * _ODD[0] + h[gap:] * _ODD[gap]))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype("i8")


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) over binary features."""

    def __init__(self, bits: int = BITS, alpha: float = 0.15, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = BITS, rounds: int = 4) -> np.ndarray:
    """Weights of all coordinates, the last one the bias. rows: each document's distinct coordinates."""
    model, draw = Ftrl(bits), np.random.default_rng(7)
    for _ in range(rounds):
        for i in draw.permutation(len(rows)):
            model.learn(np.append(rows[i], 1 << bits), int(labels[i]), float(weights[i]))
    return model.weights(np.arange((1 << bits) + 1))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias. It reads a sample: about sample_docs documents of each label, whole texts, weighted back to the labels' shares.

    Rows of labels with a null toxic or doc_id are not used; of several labels of one document the greatest counts; repeated
    rows of docs are fitted as often as they occur. All coordinates of the sample are fitted. Without labels of both kinds the
    model is a bias of -3.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(0, "i8"), np.zeros(0), -3.0
    if not counts.get(1) or not counts.get(0):
        return none
    share = {k: min(1.0, sample_docs / n) for k, n in counts.items()}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = marked.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(word_hashes)
        for batch in small_parts(batches):
            cut = [plain_words(t) for t in batch.column("text").to_pylist()]
            rows = [np.unique(features(v)).astype("<u4").tobytes() for v in cache.values(cut)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "at": pa.array(rows, pa.binary())})

    got = documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(tidied(run), "doc_id long, toxic int, at binary").toArrow()  # the sample is bounded
    got = got.sort_by("doc_id")
    rows = [np.frombuffer(x.as_buffer(), "<u4") for x in got.column("at")]
    if not rows:
        return none
    y = got.column("toxic").to_numpy()
    weight = np.where(y == 1, 1.0, share[1] / share[0])
    w = fit(rows, y, weight)
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


class Scorer:
    """Scores of texts in a worker: a dense table of the weights and a cache of word hashes."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.used, self.bias = np.zeros(1 << BITS, "f8"), np.zeros(1 << BITS, bool), bias
        self.table[at] = weights
        self.used[at] = True
        self.cache = HashCache(word_hashes)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, own in enumerate(self.cache.values([plain_words(t) for t in texts])):
            if len(own):
                found = features(own)
                z[i] += self.table[np.unique(found[self.used[found]])].sum()
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row of docs; a text's repeats of a feature count once, null and empty texts score the bias alone.

    Repeated rows give repeated rows, an empty table an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # the weights that L1 left; 2^20 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in small_parts(batches):
            p = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype("i4"))})

    return documents(docs).mapInArrow(tidied(run), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns, in one pass and without a shuffle.

    Nulls stay as they are and score as empty texts do; each of repeated rows is judged alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as in score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in small_parts(batches):
            yield batch.filter(pa.array(scorer.scores([t or "" for t in batch.column("text").to_pylist()]) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)


def predict_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: trained on labels that are not held out, applied to all.

    Nulls, empty texts, repeated rows and empty tables are as score and train have them; a null doc_id is not held out.
    """
    model = train(docs, labels.where(~held_out(4, 2)))
    return score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
