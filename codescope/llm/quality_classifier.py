"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are hashed byte trigrams of the whole text and a few of its form (repeated words and lines, capitals, length). Their
counts, damped and weighted by inverse document frequency, are projected on the leading singular vectors of a labelled
sample. The labelled vectors are broadcast; blocks of documents are multiplied with all of them, and the nearest vote for
their labels with weights that rise with the cosine.

The sample has at most SAMPLE labelled rows, the first by a hash of doc_id, so the broadcast is at most 2 MB.

Defined results: null, empty and blank texts are scored by their form terms; a document with two labels counts as the lower;
without labelled rows all scores are 0.5; equal texts score alike; an empty table gives no rows; further columns aren't
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .text_features import DIMS, counted_sample, held_out, training_rows, trigrams

SAMPLE = 6000
FORM = 16
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 8


def count(text: str | None) -> np.ndarray:
    """Trigram counts, then terms of form, each a graded count."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = len(words), len(lines)
    bigrams = len(set(zip(words, words[1:], strict=False)))
    letters = sum(map(len, words)) or 1
    grade = lambda share: round(60 * min(1.0, max(0.0, share)))
    a = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((a - np.uint8(65)) < 26) + np.count_nonzero((a[1:] - np.uint8(128) < 31) & (a[:-1] == 0xC3)))
    digits = int(np.count_nonzero((a - np.uint8(48)) < 10))
    marks = sum(map(raw.count, (b".", b"!", b"?")))
    form = [
        grade(1 - len(set(words)) / n) if n else 0, grade(1 - bigrams / (n - 1)) if n > 1 else 0, grade(1 - len(set(lines)) / m) if m else 0,
        grade(sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) / letters * 4), grade(upper / letters), grade(digits / letters * 2),
        grade(raw.count(b"!") / letters * 5), grade(abs(marks / n - 0.1) * 4) if n else 60, grade(letters / n / 20) if n else 60,
        *(60 if lo <= n < hi else 0 for lo, hi in ((0, 5), (5, 20), (20, 50), (50, 100), (100, 1 << 60))), grade(raw.count(b"|") / letters * 5), grade(m / n * 3) if n else 0,
    ]
    return np.concatenate([trigrams(raw), form])


class Neighbours:
    def __init__(self, labels: list, x: np.ndarray):
        self.labels = np.array(labels, np.float32)
        if not len(labels):
            return
        df = (x > 0).sum(0)
        self.idf = (np.log((1 + len(x)) / (1 + df)) + 0.2).astype(np.float32)
        self.idf[DIMS:] = 2.0
        w = self._weighed(x)
        values, vectors = np.linalg.eigh((w.T @ w).astype(np.float64))
        self.axes = vectors[:, ::-1][:, :RANK].astype(np.float32)
        self.vectors = self._unit(w @ self.axes)

    def _weighed(self, x: np.ndarray) -> np.ndarray:
        w = x.astype(np.float32)
        grams = np.sqrt(w[:, :DIMS]) * self.idf[:DIMS]
        grams /= np.maximum(np.sqrt((grams * grams).sum(1, keepdims=True)), 1e-6)
        return np.concatenate([grams, np.sqrt(w[:, DIMS:] / 60) / 2], 1)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-6)

    def score(self, texts: list) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        v = self._unit(self._weighed(np.stack([count(t) for t in texts])) @ self.axes)
        cos = v @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """labels (doc_id, label 0 or 1), already without rows that mustn't be learnt from."""
    ids = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found, x = counted_sample(docs, ids, count, DIMS + FORM)
    return Neighbours(found, x)


def scored(docs: DataFrame, model: Neighbours) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")).where(training_rows())
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
