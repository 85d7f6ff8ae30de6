"""Quality scores: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

Words are runs of letters and digits or of punctuation; words and pairs of neighbours are hashed into a
fixed number of buckets; pairs of a word and itself share one. A text's features are the shares of its n-grams per bucket; its score is the
logistic function of a sparse dot product with the weights, most of which the L1 term keeps at zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import short_batches

BUCKETS = 1 << 20
#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 5000
EPOCHS = 2
#: Step size and regularisation of the updates.
STEP, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0
#: Shares are small; they are counted in units of 1 / SCALE.
SCALE = 20.0
REPEATED = np.uint64(0x5851F42D4C957F2D)
WORD = re.compile(r"\w+|[^\w\s]+")


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and word pairs of a whole text; none for a null or empty text."""
    words = WORD.findall(text) if text else []
    h = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs[h[:-1] == h[1:]] = REPEATED  # a word and itself: one n-gram, whatever the word
    mixed = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), pairs ^ pairs >> np.uint64(29)])
    return (mixed >> np.uint64(40)).astype(np.int64) % buckets


class Ftrl:
    """Per-coordinate FTRL-proximal state; the last coordinate is the intercept, which is not regularised."""

    def __init__(self, buckets: int = BUCKETS):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), L1)
        if isinstance(at, slice) or at[-1] == len(self.z) - 1:
            l1[-1] = 0
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / STEP + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (_logistic(float(w @ x)) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / STEP
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _logistic(v: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(v, -35, 35))))


def _features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(ngrams(text, buckets), return_counts=True)
    return np.append(at, buckets), np.append(count * (SCALE / max(1, count.sum())), 1.0)


def fit_texts(rows: list[tuple[str | None, int]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (text, label) rows, in their order, ``epochs`` times."""
    model = Ftrl(buckets)
    seen = [(*_features(t, buckets), float(y)) for t, y in rows]
    for _ in range(epochs):
        for one in seen:
            model.learn(*one)
    return model.weights()


def score_text(text: str | None, weights: np.ndarray) -> float:
    at = ngrams(text, len(weights) - 1)
    return _logistic(float(weights[-1] + (weights[at].sum() * (SCALE / len(at)) if len(at) else 0.0)))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most ``sample_rows`` labelled rows of ``docs`` (doc_id, text), whole texts.

    The sample is chosen by a hash of the id before any text is read, so only its texts move, to one
    task, which fits the model; the weights (at most ``buckets``) go to the driver. Null labels and
    ids are no labels; of several labels the smallest counts; without labels all scores are 0.5.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = known.orderBy(*order).limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(t, y) for b in batches for t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        weights = fit_texts(seen, buckets, epochs)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([weights[at].astype("<f4").tobytes()])], ["at", "w"])

    short_batches(docs.sparkSession)
    one = rows.repartitionByRange(1, *order).sortWithinPartitions(*order, "text").select("text", "quality")
    weights = np.zeros(buckets + 1, np.float32)
    for r in one.mapInArrow(run, "at binary, w binary").collect():
        weights[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["w"], "<f4")
    return weights


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): null and empty texts score what the intercept says. Repeated rows and null ids stay; other columns are not read."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score_text(t, shared.value) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op7_ngram_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the whole documents table; rows whose crc32(doc_id) mod 4 is 2 are never learnt from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = score(docs, fit(docs, labels.where(~held)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
