"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixed(a: DataFrame, b: DataFrame, key: str, suffixes=("_pred", "_true")) -> DataFrame:
    """Inner join on key; columns that both have get a suffix."""
    both = (set(a.columns) & set(b.columns)) - {key}
    a, b = (d.withColumnsRenamed({c: c + s for c in both}) for d, s in zip((a, b), suffixes, strict=True))
    return a.join(b, key)


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default=None, dim_key: str | None = None) -> DataFrame:
    """df with value of dim by key, or default; Spark broadcasts dim if its size allows."""
    d = dim.select(F.col(dim_key or key).alias("_k"), F.col(value).alias("_v"))
    out = df.drop(value) if value in df.columns else df
    return out.join(d, F.col(key) == F.col("_k"), "left").withColumn(value, F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")).drop("_k", "_v")


def embedding_lookup(nodes: DataFrame, texts: DataFrame, size: int, compat: bool = False) -> DataFrame:
    """nodes (text, ...) with the embedding of their text; a miss is a zero vector, or with compat that of "" or else of row 0."""
    d = texts.select(F.col("text").alias("_t"), F.col("embedding").alias("_e"))
    out = nodes.join(d, F.col("text") == F.col("_t"), "left")
    if not compat:
        return out.withColumn("embedding", F.coalesce("_e", F.array_repeat(F.lit(0.0), size))).drop("_t", "_e")
    spare = texts.agg(F.coalesce(F.first(F.when(F.col("text") == "", F.col("embedding")), ignorenulls=True), F.min_by("embedding", "text_idx")).alias("_s"))
    return out.crossJoin(F.broadcast(spare)).withColumn("embedding", F.coalesce("_e", "_s")).drop("_t", "_e", "_s")


def zipped(key: str, *frames: DataFrame) -> DataFrame:
    """Tables of one row a key side by side; an error if their sizes differ."""
    if len({f.count() for f in frames}) > 1:
        raise ValueError("tables of different sizes")
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def stacked_probabilities(key: str, *frames: DataFrame, probs: str = "probs") -> DataFrame:
    """(key, features): the probability vectors of all tables end to end."""
    out = frames[0].select(key, F.col(probs).alias("_p0"))
    for k, f in enumerate(frames[1:], 1):
        out = out.join(f.select(key, F.col(probs).alias(f"_p{k}")), key)
    return out.select(key, F.concat(*(f"_p{k}" for k in range(len(frames)))).alias("features"))


def mean_pool(vectors: Column, mask: Column, size: int) -> Column:
    """The mean of the vectors whose mask is 1; zeros if there is none."""
    summed = F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m)), F.array_repeat(F.lit(0.0), size), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    return F.transform(summed, lambda x: x / n)
