"""Places and cumulative sums in a total order, and the first n of one, without a task that holds all rows or n of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialised

#: Rows a range, about; and rows that one task may sort at last.
RANGE_ROWS = 1_000_000
FEW = 10_000


def running(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df with _place (from 0) in the order, which should tell all rows apart, and for each of sums the total of that column over the
    rows before. Rows are sorted by ranges over all keys, as many as the session's shuffle partitions or more where they are many,
    into a table, so that places don't hang on how often the ranges are drawn; then each range's counts are summed, a row a range."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    at = F.monotonically_increasing_id()
    rows = materialised(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at), "running").withColumn("_range", F.shiftright("_at", 33))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_place"), *(F.sum(c).alias(k) for k, c in sums.items()))
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("_range", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_before_{c}") for c in ("_place", *sums)))
    inner = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = {"_place": F.row_number().over(Window.partitionBy("_range").orderBy("_at")) - 1, **{k: F.coalesce(F.sum(c).over(inner), F.lit(0)) for k, c in sums.items()}}
    return rows.join(F.broadcast(before), "_range").select(*df.columns, *((F.col(f"_before_{k}") + v).alias(k) for k, v in own.items()))


def nth(df: DataFrame, key: Column, n: int, step: int) -> tuple[str, int] | None:
    """The n-th smallest (from 1) value of a string key, nulls as empty, and how many rows have smaller ones; None where there are
    fewer than n rows. Rows are counted by the first step characters of the key; the one beginning in which the n-th lies is counted
    by the next step characters, and so on until few rows or one value is left. All that is sorted is a count a beginning."""
    keys = df.select(F.coalesce(key, F.lit("")).alias("k"))
    known, before, length = "", 0, 0
    while True:
        length += step
        counts = keys.where(F.startswith("k", F.lit(known))).groupBy(F.substring("k", 1, length).alias("p")).agg(F.count("*").alias("c"))
        up = counts.withColumn("up", F.sum("c").over(Window.orderBy("p")))  # a row a beginning
        found = up.where(F.col("up") >= n - before).orderBy("p").select("p", "c", "up").first()
        if not found:
            return None
        known, before = found["p"], before + found["up"] - found["c"]
        if len(known) < length:
            return known, before
        if found["c"] <= FEW:
            held = [r["k"] for r in keys.where(F.startswith("k", F.lit(known))).groupBy("k").agg(F.count("*").alias("c")).orderBy("k").select("k", "c").collect() for _ in range(r["c"])]
            return held[n - before - 1], before + held.index(held[n - before - 1])


def first_rows(df: DataFrame, key: Column, n: int, step: int = 3) -> DataFrame:
    """The n rows of df with the smallest key, a string; of several with the last key, any. Texts don't leave their place: rows are
    chosen by comparing their key with the n-th; only rows that share the n-th key go through a limit."""
    found = nth(df, key, n, step) if n > 0 else ("", 0)
    if found is None:
        return df
    key = F.coalesce(key, F.lit(""))
    return df.where(key < found[0]).unionByName(df.where(key == found[0]).limit(max(0, n - found[1])))
