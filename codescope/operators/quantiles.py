"""Exact quantiles by narrowing histograms: no task holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialised

#: Ranges that a value range is cut into in each round, and values of a group that are sorted at last.
CELLS = 1024
FEW = 4096


def quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> DataFrame:
    """(by, share, value): exact quantiles of each group with linear interpolation between the two nearest ranks, nulls, NaN and
    infinities left out. Every rank sought has a range of values that holds it, at first from the least to the greatest. A round
    counts the values of each range by cells and keeps, of each range, the cell that holds the rank; once all ranges hold few
    values, or a single distinct one, the rank is found by a running count over the distinct values left. Each round is a pass over
    the values whose counts, at most CELLS a rank, are all that is shuffled. A row a group and share is broadcast, so groups are
    classes, not keys: a few thousand at most."""
    x = F.col(value).cast("double")
    ok = materialised(df.select((F.col(by) if by else F.lit(0)).alias("g"), x.alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"), "quantiles")
    ends = ok.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sought = ends.select("g", F.explode(F.array(*map(F.lit, shares))).alias("share"), "n", "lo", "hi").withColumn("at", F.col("share") * (F.col("n") - 1))
    sides = F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")
    ranks = sought.select("g", "share", "at", sides, "lo", "hi").distinct()
    # (g, rank): the rank sought, lo and hi: the values that it lies between, below: how many are less than lo, inside: from lo to hi
    rows = [(r["g"], r["rank"], r["lo"], r["hi"], 0, r["n"]) for r in ranks.join(ends.select("g", "n"), ranks["g"].eqNullSafe(ends["g"])).select(ranks["g"], "rank", "lo", "hi", "n").distinct().collect()]  # a few a group
    schema = f"g {ok.schema['g'].dataType.simpleString()}, rank long, lo double, hi double, below long, inside long"
    while any(r[5] > FEW and r[2] < r[3] for r in rows):
        now = df.sparkSession.createDataFrame(rows, schema)
        counted = _held(ok, now).groupBy("g", "rank", "lo", "hi", "below", "inside", _cell().alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("from"), F.max("x").alias("to"))
        run = Window.partitionBy("g", "rank").orderBy("cell")
        placed = counted.withColumn("up", F.col("below") + F.sum("c").over(run))
        rows = [tuple(r) for r in placed.where("rank < up AND rank >= up - c").select("g", "rank", "from", "to", (F.col("up") - F.col("c")).alias("below"), "c").collect()]
    now = df.sparkSession.createDataFrame(rows, schema)
    left = _held(ok, now).groupBy("g", "rank", "below", "x").agg(F.count("*").alias("c"))
    up = F.col("below") + F.sum("c").over(Window.partitionBy("g", "rank").orderBy("x"))
    found = left.withColumn("up", up).where("rank < up AND rank >= up - c").select(F.col("g").alias("fg"), F.col("rank").alias("fr"), "x")
    two = ranks.select("g", "share", "at", "rank").join(F.broadcast(found), F.col("g").eqNullSafe(F.col("fg")) & (F.col("rank") == F.col("fr")))
    part = F.col("at") - F.floor("at")
    low, high = F.max(F.when(F.col("rank") == F.floor("at"), F.col("x"))), F.max(F.when(F.col("rank") == F.ceil("at"), F.col("x")))
    out = two.withColumn("part", part).groupBy("g", "share").agg(low.alias("low"), high.alias("high"), F.max("part").alias("part"))
    result = F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part"))
    return out.select(*([F.col("g").alias(by)] if by else []), "share", result.alias("value"))


def _held(ok: DataFrame, now: DataFrame) -> DataFrame:
    """The values of ok that lie in the range of a rank, a row a rank."""
    n = now.withColumnRenamed("g", "ng")
    return ok.join(F.broadcast(n), F.col("g").eqNullSafe(F.col("ng")) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).drop("ng")


def _cell():
    """Which of CELLS equal parts of a range a value is in. The span is halved first, as it may be beyond a double's."""
    part = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    return F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.lit(CELLS - 1), F.floor(part * CELLS))).cast("int")
