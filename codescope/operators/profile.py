"""Profiles, counts, duplicates, leakage and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def with_percent(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their percentage; the total is one row, joined by broadcast."""
    total = counts.agg(F.sum(n).alias("_t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col(n) / F.col("_t")).drop("_t")


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct if approximate else F.countDistinct)(column).alias("n_distinct"))


def first_by(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    return df.groupBy(group).agg(F.min_by(value, order).alias(f"first_{value}"))


def mode_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(f"mode_{value}"))


def majority(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"))


def crosstab(df: DataFrame, rows: str, column: str, values: list) -> DataFrame:
    return df.groupBy(rows).pivot(column, values).count().na.fill(0)


def length_profile(df: DataFrame, code: str = "code") -> DataFrame:
    """Minimum, median, mean, maximum and 95th percentile of characters and of words, exact."""
    words = F.size(F.filter(F.split(code, r"(?U)\s+"), lambda w: w != ""))
    df = df.select(F.length(code).alias("chars"), words.alias("tokens"))
    stats = lambda c: (F.min(c).alias(f"{c}_min"), F.median(c).alias(f"{c}_median"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.percentile(c, F.lit(0.95)).alias(f"{c}_p95"))  # noqa: E731  lengths are few
    return df.agg(*stats("chars"), *stats("tokens"))


def short_snippets(df: DataFrame, code: str = "code", limits=(5, 10, 20)) -> DataFrame:
    n = F.size(lines_of(F.col(code)))
    return df.agg(*(F.avg((n <= k).cast("int") * 100.0).alias(f"at_most_{k}") for k in limits))


def duplicates(df: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose text an earlier row has: counts by hash, so that only hashes are shuffled."""
    by = df.select(F.md5(code).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    return by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def prefix_hash(code: Column, size: int | None) -> Column:
    return F.md5(F.substring(code, 1, size) if size else code)


def leakage(train: DataFrame, val: DataFrame, size: int | None = None, code: str = "code") -> DataFrame:
    """How many distinct texts (or prefixes) of val also are in train, and their percentage."""
    of = lambda df: df.select(prefix_hash(F.col(code), size).alias("h")).where("h IS NOT NULL").distinct()
    v, both = of(val), of(val).join(of(train), "h", "left_semi")
    counts = v.agg(F.count("*").alias("n_val")).crossJoin(both.agg(F.count("*").alias("n_overlap")))
    return counts.withColumn("percent", 100.0 * F.col("n_overlap") / F.greatest("n_val", F.lit(1))).withColumn("warn", F.col("percent") > 1.0)


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def common(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def missing(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a that b lacks."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")


def is_subset(a: DataFrame, b: DataFrame, column: str) -> bool:
    return missing(a, b, column).isEmpty()


def unknown_languages(df: DataFrame, language: str = "language") -> DataFrame:
    from .clean import language_alias

    return df.where(F.col(language).isNotNull() & language_alias(F.col(language)).isNull()).groupBy(language).agg(F.count("*").alias("n"))


def score_stats(df: DataFrame, score: str, label: str = "label", classes: int | None = None) -> DataFrame:
    """Mean, population deviation and exact median of finite scores by label; with classes, a row for each of 0 to classes - 1, zeros
    where a class has no score."""
    from .quantiles import quantiles

    ok = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    stats = ok.groupBy(label).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    half = quantiles(ok, score, [0.5], label).select(F.col(label).alias("_l"), F.col("value").alias("median"))
    out = stats.join(half, F.col(label).eqNullSafe(F.col("_l")), "left").drop("_l")
    if classes is None:
        return out
    dim = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    return dim.join(out.withColumn(label, F.col(label).cast("int")), label, "left").na.fill(0, ["n"]).na.fill(0.0, ["mean", "std", "median"])


def confidence_stats(df: DataFrame, probs: str) -> DataFrame:
    c = F.array_max(probs)
    return df.agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("least"))


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column."""
    return df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def scaled(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    df = df.crossJoin(F.broadcast(fitted))
    for c in columns:
        df = df.withColumn(c, (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")))
    return df.drop(*fitted.columns)


def class_weights(df: DataFrame, classes: int, kind: str = "inverse", label: str = "label") -> DataFrame:
    """(label, n, weight) for labels 0 to classes - 1. inverse: 1/n, mean 1; total: total/(K n), renormalised to sum K; both take
    an absent class as one row; total_one: as total, but an absent class has weight 1 before the sum is made K. balanced: total/(K n),
    absent classes left out."""
    dim = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    counts = dim.join(df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n")), label, "left").na.fill(0, ["n"])
    w = Window.partitionBy()  # a row a class
    if kind == "balanced":
        counts = counts.where("n > 0")
        return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))
    counts = counts.withColumn("raw", (1.0 if kind == "inverse" else F.sum("n").over(w) / classes) / F.greatest("n", F.lit(1)))
    if kind == "total_one":
        counts = counts.withColumn("raw", F.when(F.col("n") == 0, 1.0).otherwise(F.col("raw")))
    return counts.withColumn("weight", F.col("raw") / F.avg("raw").over(w)).drop("raw")
