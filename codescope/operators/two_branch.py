"""A head with two branches: an embedding and handcrafted features each go through a network of their own, and a third one classifies
what both have learnt, side by side.

Spark ML's perceptron has one input, so the branches are trained first, each on the labels; the activations of their last hidden
layers, computed from the fitted weights, are the input of the fusion. The fits are distributed; weights are as many as the layers say.
Embeddings are normalised by row (mean 0, deviation 1); features that aren't finite are 0, and all are cut to [-5, 5]. A null embedding
is a zero vector. Rows without a label aren't fitted on; columns named as the outputs are replaced."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, finite
from ..sources.io import materialised

MOST = 5.0


def normalised(vectors: pd.Series, size: int) -> np.ndarray:
    """A row a vector, with mean 0 and deviation 1; entries that aren't finite count as 0. Zeros for null, for a vector of another
    size, and where all entries are equal."""
    rows = [np.asarray(v, float) if v is not None and len(v) == size else np.zeros(size) for v in vectors]
    a = np.nan_to_num(np.stack(rows), nan=0.0, posinf=0.0, neginf=0.0)
    a -= a.mean(axis=1, keepdims=True)
    d = a.std(axis=1, keepdims=True)
    return np.divide(a, d, out=np.zeros_like(a), where=d > 0)


def _layers(model: MultilayerPerceptronClassificationModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of each layer. The model's vector has a layer's weights by column, then its bias."""
    flat, sizes, out, at = model.weights.toArray(), model.getLayers(), [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def _through(layers, a: np.ndarray) -> np.ndarray:
    """What comes out of layers of logistic units."""
    for w, b in layers:
        a = 1.0 / (1.0 + np.exp(-np.clip(a @ w + b, -500, 500)))
    return a


@dataclass
class TwoBranches:
    embedding: str
    features: list[str]
    size: int
    embedded: MultilayerPerceptronClassificationModel
    crafted: MultilayerPerceptronClassificationModel
    fusion: MultilayerPerceptronClassificationModel

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction and probs. The three networks run in one pass over Arrow batches."""
        one, two, three = (_layers(m) for m in (self.embedded, self.crafted, self.fusion))
        size = self.size

        @F.pandas_udf("array<double>")
        def run(vectors: pd.Series, crafted: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            both = np.hstack([_through(one[:-1], normalised(vectors, size)), _through(two[:-1], np.stack(crafted.to_numpy()))])
            w, b = three[-1]
            z = _through(three[:-1], both) @ w + b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

        kept = [F.col(f"`{c}`") for c in df.columns if c not in ("prediction", "probs")]
        out = df.select(*kept, run(F.col(self.embedding).cast("array<double>"), _crafted(self.features)).alias("probs"))
        return out.select(*kept, (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("prediction"), "probs")


def _crafted(features: list[str]) -> Column:
    return F.array(*(clip(finite(F.col(f"`{c}`").cast("double")), -MOST, MOST) for c in features))


def inputs(df: DataFrame, embedding: str, features: list[str], size: int, label: str) -> DataFrame:
    """(label, e, f): what the branches take."""

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(normalised(vectors, size)) if len(vectors) else [], dtype=object)

    return df.select(F.col(label).cast("double").alias("label"), run(F.col(embedding).cast("array<double>")).alias("e"), _crafted(features).alias("f"))


def activations(df: DataFrame, embedded: MultilayerPerceptronClassificationModel, crafted: MultilayerPerceptronClassificationModel) -> DataFrame:
    """(label, hidden): of rows (label, e, f), the last hidden layers of both branches side by side."""
    one, two = _layers(embedded)[:-1], _layers(crafted)[:-1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                e, f = (b.column(k).flatten().to_numpy().reshape(b.num_rows, -1) for k in (1, 2))
                both = np.hstack([_through(one, e), _through(two, f)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(both), pa.list_(pa.float64()))], names=["label", "hidden"])

    return df.select("label", "e", "f").mapInArrow(run, "label double, hidden array<double>")


def fit(df: DataFrame, embedding: str, features: list[str], size: int, classes: int, branch=(256, 128), fusion=(256,), label: str = "label", iterations: int = 100, seed: int = 42) -> TwoBranches:
    """The three networks. branch and fusion are their hidden layers; a label is 0 to classes - 1. What is fitted on is written once
    (io.materialised), as each fit passes over it many times."""
    d = materialised(inputs(df.where(F.col(label).isNotNull()), embedding, features, size, label), "two-branches")

    def net(rows: DataFrame, column: str, layers) -> MultilayerPerceptronClassificationModel:
        return MultilayerPerceptronClassifier(featuresCol="v", labelCol="label", layers=[*layers, classes], maxIter=iterations, seed=seed).fit(rows.select("label", array_to_vector(column).alias("v")))

    one, two = net(d, "e", (size, *branch)), net(d, "f", (len(features), *branch))
    three = net(materialised(activations(d, one, two), "activations"), "hidden", (2 * branch[-1], *fusion))
    return TwoBranches(embedding, features, size, one, two, three)
