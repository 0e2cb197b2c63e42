"""Sampling and balancing. Membership is decided by md5(seed|id), so reruns and partitionings agree; counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import first_rows


def draw(id_: str = "ID", seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string")))


def _ranked(df: DataFrame, by: list[str], id_: str, seed: int) -> DataFrame:
    """df with _r, the place of a row in its group's order of draws. A group is cut by the first digits of the draw into 4,096 parts,
    which are counted first, so that no task holds a group."""
    cut = F.substring(draw(id_, seed), 1, 3)
    named = [F.col(b).alias(f"_g{k}") for k, b in enumerate(by)]
    sizes = df.select(*named, cut.alias("_part")).groupBy(*(f"_g{k}" for k in range(len(by))), "_part").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*(f"_g{k}" for k in range(len(by)))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*(f"_g{k}" for k in range(len(by))), "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    placed = df.withColumn("_cut", cut).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_cut").orderBy(draw(id_, seed), id_)))
    same = F.col("_cut") == F.col("_part")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(before, same).withColumn("_r", F.col("_r") + F.col("_before")).select(*df.columns, "_r")


def sample_rows(df: DataFrame, n: int, id_: str = "ID", seed: int = 42) -> DataFrame:
    """The n rows drawn first. No task sorts them: which they are follows from the n-th draw (first_rows)."""
    return first_rows(df, draw(id_, seed), n)


def cap(df: DataFrame, by: list[str], most: int, id_: str = "ID", seed: int = 42) -> DataFrame:
    """At most so many rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(draw(id_, seed), id_))).where(F.col("_r") <= most).drop("_r")


def balance_cap(total: int, n_a: int, n_b: int, step: int = 50) -> int:
    return max(total // (n_a * n_b) // step * step, step)


def balanced(df: DataFrame, by: list[str], total: int, id_: str = "ID", seed: int = 42) -> DataFrame:
    """Cap of (language, label) groups such that about total rows stay."""
    a, b = df.agg(F.countDistinct(by[0]), F.countDistinct(by[1])).first()
    return cap(df, by, balance_cap(total, max(a, 1), max(b, 1)), id_, seed)


def equal_groups(df: DataFrame, by: str, most: int | None = None, id_: str = "ID", seed: int = 42) -> DataFrame:
    """Each group cut to most // groups rows, or to the smallest group."""
    sizes = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("groups"))
    limit = F.floor(F.lit(most) / F.col("groups")) if most else F.col("least")
    return _ranked(df, [by], id_, seed).crossJoin(F.broadcast(sizes)).where(F.col("_r") <= limit).drop("_r", "least", "groups")


def water_filled(df: DataFrame, budget: int, label: str = "label", id_: str = "ID", seed: int = 42) -> DataFrame:
    """Classes from small to large each keep at most an even share of what is left of the budget."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", F.col(label).alias("label")))).alias("cs"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<label:string,keep:bigint>>").alias("out"))

    def give(a: Column, c: Column) -> Column:
        rest = F.size("cs") - F.size(a["out"])
        keep = F.least(c["n"], F.floor(a["left"] / rest))
        return F.struct((a["left"] - keep).alias("left"), F.concat(a["out"], F.array(F.struct(c["label"].cast("string").alias("label"), keep.alias("keep")))).alias("out"))

    caps = sizes.select(F.explode(F.aggregate("cs", start, give)["out"]).alias("x")).select(F.col("x.label").alias("_l"), F.col("x.keep").alias("_keep"))
    return _ranked(df, [label], id_, seed).join(F.broadcast(caps), F.col(label).cast("string").eqNullSafe(F.col("_l"))).where("_r <= _keep").drop("_r", "_l", "_keep")  # a row a class


def proportional(df: DataFrame, n: int, by: str = "label", id_: str = "ID", seed: int = 42) -> DataFrame:
    """Of each group its share of n, rounded down, at least one row."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    whole = df.agg(F.count("*").alias("_all"))
    quota = sizes.crossJoin(F.broadcast(whole)).select(F.col(by).alias("_b"), F.greatest(F.lit(1), F.floor(F.col("_n") * n / F.col("_all"))).alias("_q"))
    return _ranked(df, [by], id_, seed).join(quota, F.col(by).eqNullSafe(F.col("_b"))).where("_r <= _q").drop("_r", "_b", "_q")


def stratified_split(df: DataFrame, share: float = 0.7, by: str = "label", id_: str = "ID", seed: int = 42) -> DataFrame:
    """df with split: train for the first share of each group (rounded), else test."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_b")
    ranked = _ranked(df, [by], id_, seed).join(sizes, F.col(by).eqNullSafe(F.col("_b")))
    return ranked.withColumn("split", F.when(F.col("_r") <= F.round(F.col("_n") * share), "train").otherwise("test")).drop("_r", "_n", "_b")


def chosen(id_: str, ratio: float, seed: int = 42) -> Column:
    """True for about that share of ids."""
    return F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(1_000_000)) < int(ratio * 1_000_000)
