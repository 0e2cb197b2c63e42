"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte trigrams predicts each bit (ridge regression on +1 and
-1, all languages weighing the same). Decoding adds up, for each language, the squared hinge losses of the bits against its
codeword, weighted by how well each bit's classifier does, and takes the least; close calls are flagged.

The classifiers are fitted on at most SAMPLE rows in all, the first of each language by a hash of doc_id. Texts are read whole.

Defined results: a null text or one without letters is `und` with score 0; without labelled rows every text is; equal
texts are predicted alike; more than MOST_LANGS distinct labels are an error; ties go to the language first by code point; an empty table gives no rows; further columns
aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .text_features import DIMS, counted_sample, held_out, training_rows, trigrams

SAMPLE = 6000
#: More distinct labels than this are no languages: fitting fails. At least one row of each is in the sample.
MOST_LANGS = 1000
RIDGE = 3.0
AMBIGUOUS = 0.1
UNKNOWN = "und"


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits in two for up to 6, else random distinct ones."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 6:
        rows = [[1 if l == 0 or not (m >> (l - 1)) & 1 else -1 for m in range(1, 1 << max(languages - 1, 0))] for l in range(languages)]
        return np.array(rows, np.float64).reshape(languages, -1)
    rng, bits = np.random.default_rng(seed), max(31, 6 * int(np.ceil(np.log2(languages))))
    best = max((rng.choice([-1.0, 1.0], (languages, bits)) for _ in range(50)), key=lambda c: ((bits - c @ c.T) / 2 + bits * np.eye(languages)).min())
    return best[:, np.abs(best.sum(0)) < languages]


def count(text: str | None) -> np.ndarray:
    return trigrams((text or "").lower().encode())


def scaled(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)


class Codes:
    """The fitted classifiers: langs, words, w (dims x bits), bias, weight of each bit."""

    def __init__(self, langs: list[str], labels: list[str], x: np.ndarray):
        self.langs, self.words = langs, codewords(len(langs))
        if len(langs) < 2:
            return
        x, at = scaled(x).astype(np.float64), np.searchsorted(np.array(langs, dtype=object), labels)
        y = self.words[at]
        share = (len(labels) / (len(langs) * np.bincount(at, minlength=len(langs))))[at][:, None]
        self.mean = (share * x).sum(0) / share.sum()
        x -= self.mean
        folds = np.arange(len(x)) % 2
        err = np.zeros(y.shape[1])
        for f in (0, 1):  # what each bit gets wrong in the half it wasn't fitted on
            w, b = self._fit(x[folds != f], y[folds != f], share[folds != f])
            err += ((x[folds == f] @ w + b) * y[folds == f] <= 0).sum(0)
        err = (err + 1) / (len(x) + 2)
        self.weight = np.log((1 - np.minimum(err, 0.49)) / np.minimum(err, 0.49))
        self.weight /= self.weight.sum()
        self.w, self.b = self._fit(x, y, share)

    @staticmethod
    def _fit(x, y, share):
        b = (share * y).sum(0) / share.sum()
        a = x.T @ (share * x)
        a[np.diag_indices_from(a)] += RIDGE
        return np.linalg.solve(a, x.T @ (share * (y - b))), b

    def predict(self, texts: list) -> tuple[list, list, list]:
        """Language, score and ambiguity of each text."""
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if len(self.langs) == 1:
            return [self.langs[0] if k else UNKNOWN for k in known], [float(k) for k in known], [not k for k in known]
        x = scaled(np.stack([count(t) for t in texts]))
        margins = (x - self.mean) @ self.w + self.b
        loss = np.stack([(self.weight * np.maximum(0, 1 - margins * c) ** 2).sum(1) for c in self.words], 1)
        best = loss.argmin(1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p = p.max(1) / p.sum(1)
        two = np.partition(loss, 1, axis=1)[:, :2]
        close = (two[:, 1] - two[:, 0]) < AMBIGUOUS
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(v) if k else 0.0 for v, k in zip(p, known, strict=True)], [bool(c) or not k for c, k in zip(close, known, strict=True)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Codes:
    """docs (doc_id, text, lang), already without rows that mustn't be learnt from."""
    named = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    langs = sorted(r["lang"] for r in named.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} distinct values of lang: clean the labels first")
    if not langs:
        return Codes([], [], np.zeros((0, DIMS)))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = named.select("doc_id", F.col("lang").alias("label"), "lang").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(1, sample // len(langs))).select("doc_id", "label")
    labels, x = counted_sample(docs.select("doc_id", "text"), ids, count, DIMS)
    return Codes(langs, labels, x)


def identified(docs: DataFrame, codes: Codes) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                lang, score, close = held.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identified(docs, fit(docs.where(training_rows())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
