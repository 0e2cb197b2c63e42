"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources in order of code point (null last) weigh 3, 1, 2, repeating. Targets share 150 % of all words by weight; none exceeds
twice its source, and what is over is shared again by weight. The total is cut into blocks of BLOCK words, which go to the
sources by highest quotients, and within a source to its shards likewise: integer quotas. A source's words, shard by shard
in order of doc_id, form blocks; every block is taken as often as the quota covers the shard whole, and a seeded order of
the blocks says which are taken once more.

Defined results: null and blank texts have size 0 and nothing taken; rows without source are one source, the last; rows
without doc_id are dealt to shards by size; rows that repeat a doc_id are counted by row and returned once each; very long texts
are split among blocks like others; equal ranks go by shard or block number; a source without words
has target 0; an empty table gives no rows; further columns are kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, let, running, table, word_array, written

BLOCK = 128
#: Words that a shard has about; no source has more than MOST_SHARDS shards, so beyond their product shards grow.
SHARD = 1 << 16
MOST_SHARDS = 4096
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_TIMES = 2
SEED = "mix"
#: Tables of at most so many rows, of documents (12 bytes each), shards or sources, are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast where it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(word_array(F.col("text"))).cast("long"))


def apportioned(ps: Column, seats: Column) -> Column:
    """ps: array of (w double, ...) in the order that settles ties; the seats that each gets by Sainte-Laguë.
    A divisor is sought that gives at most all seats; the few left go by the highest next quotients."""

    def filled(d: Column) -> Column:
        return F.aggregate(ps, F.lit(0).cast("long"), lambda a, p: a + F.floor(p["w"] / d + 0.5).cast("long"))

    total = F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["w"])
    low, high = total / (seats * 4 + 4 * F.size(ps) + 4), total * 2 + 1.0

    def halve(s: Column, _) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return let(mid, lambda m: let(filled(m) > seats, lambda over: F.struct(F.when(over, m).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(m).alias("hi"))))

    def of_divisor(d: Column) -> Column:
        base = F.transform(ps, lambda p: F.floor(p["w"] / d + 0.5).cast("long"))

        def topped(b: Column) -> Column:
            left = seats - F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)
            order = F.array_sort(F.transform(ps, lambda p, i: F.struct((-p["w"] / (2 * F.get(b, i) + 1)).alias("q"), i.alias("i"))))
            return let(F.transform(F.slice(order, F.lit(1), F.greatest(left, F.lit(0)).cast("int")), lambda x: x["i"]), lambda won: F.transform(b, lambda x, i: x + F.array_contains(won, i).cast("long")))

        return let(base, topped)

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(low.alias("lo"), high.alias("hi")), halve)
    return F.when(total > 0, let(fitted, lambda s: of_divisor(s["hi"]))).otherwise(F.transform(ps, lambda p: F.lit(0).cast("long")))


def targets(totals: DataFrame) -> DataFrame:
    """totals (source, source_size) -> with target (double) and quota (blocks). One row a source; no task holds all sources."""
    named = totals.select("source", F.col("source_size").alias("size"), F.col("source").isNull().alias("none"), F.encode("source", "utf-8").alias("code"))
    v = F.get(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int"))
    cap = F.col("size") * float(MOST_TIMES)
    weighed = running(named, "mix-order", ["none", "code"]).select("source", "size", F.col("place").alias("i"), v.alias("v"), cap.alias("cap"), (cap / v).alias("full_at"))
    # from the source that is full first: what is left for it and those after it, by weight
    filled = written(running(weighed, "mix-caps", ["full_at", "i"], cap_before="cap", v_before="v"), "mix-filled")
    whole = filled.agg((F.sum("size") * (SHARE_PERCENT / 100)).alias("whole"), F.sum("v").alias("all_v"))
    rate = (F.col("whole") - F.col("cap_before")) / (F.col("all_v") - F.col("v_before"))
    stop = filled.crossJoin(F.broadcast(whole)).agg(F.coalesce(F.min(F.when(rate * F.col("v") < F.col("cap"), F.col("place"))), F.count("*")).alias("stop"))  # one row
    capped = filled.crossJoin(F.broadcast(stop)).withColumn("capped", F.col("place") < F.col("stop"))
    rest = capped.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0)).alias("full"), F.sum(F.when(~F.col("capped"), F.col("v"))).alias("free")).crossJoin(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise((F.col("whole") - F.col("full")) / F.col("free") * F.col("v"))
    aimed = written(capped.crossJoin(F.broadcast(rest)).select("source", "size", "i", target.alias("w")), "mix-targets")
    return blocks_of(aimed).select("source", F.col("size").alias("source_size"), F.col("w").alias("target"), "quota")


def blocks_of(parties: DataFrame) -> DataFrame:
    """parties (source, size, i, w) -> with quota: so many blocks as all w hold, by Sainte-Laguë, ties in order of i. Half a seat a
    party is the most that rounding w / divisor adds or takes, so two divisors bound the quotients that are left to compare."""
    one = parties.agg(F.sum("w").alias("total"), F.round(F.sum("w") / BLOCK).cast("long").alias("seats"), F.count("*").alias("n"))
    near = lambda shift: F.col("total") / (F.col("seats") + shift)
    rounded = lambda d: F.floor(F.col("w") / d + 0.5).cast("long")
    slack = F.col("n") / 2 + 1
    sure = F.when(F.col("seats") > slack, rounded(near(-slack))).otherwise(F.lit(0).cast("long"))
    most = F.when(F.col("total") > 0, rounded(near(slack))).otherwise(F.lit(0).cast("long"))
    based = written(parties.crossJoin(F.broadcast(one)).select("source", "size", "i", "w", "seats", sure.alias("base"), most.alias("most")), "mix-bases")
    left = based.agg((F.max("seats") - F.sum("base")).alias("left"))
    open_ = based.where("most > base").select("i", "w", F.explode(F.sequence("base", F.col("most") - 1)).alias("j")).select("i", (-F.col("w") / (2 * F.col("j") + 1)).alias("q"))
    won = running(open_, "mix-quotients", ["q", "i"]).crossJoin(F.broadcast(left)).where("place < left").groupBy("i").agg(F.count("*").alias("more"))
    return based.join(won, "i", "left").select("source", "size", "w", (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota"))


def shards_of(size: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(size / SHARD))).cast("int")


def taken(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, size) -> doc_id, source, size, source_size, target, taken, row by row."""
    plan = written(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    plan = small(plan.withColumnRenamed("source", "s"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("size").cast("string")))
    shard = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), name)), 1, 8), 16, 10).cast("long"), shards_of(F.col("source_size"))).cast("int")
    dealt = docs.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "quota", shard.alias("shard"))
    of_shard = dealt.groupBy("source", "shard", "quota").agg(F.sum("size").alias("words"))
    by_source = of_shard.groupBy("source", "quota").agg(F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("all"))  # MOST_SHARDS at most
    listed = by_source.withColumn("ps", F.transform("all", lambda x: F.struct(x["words"].cast("double").alias("w"), x["shard"].alias("shard"))))
    quotas = listed.select("source", F.explode(F.arrays_zip("ps", apportioned(F.col("ps"), F.col("quota")).alias("q"))).alias("x")).select(F.col("source").alias("s"), F.col("x.ps.shard").alias("h"), F.col("x.q").alias("shard_quota"))
    quotas = small(written(quotas, "mix-quotas"))
    ready = dealt.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).drop("s", "h", "quota")
    group = Window.partitionBy("source", "shard")
    placed = ready.withColumn("stop", F.sum("size").over(group.orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))).withColumn("words", F.sum("size").over(group)).withColumn("row", F.row_number().over(group.orderBy("doc_id", "size")))
    first, last = F.floor((F.col("stop") - F.col("size")) / BLOCK), F.floor((F.col("stop") - 1) / BLOCK)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    seeded = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("source"), F.lit("")), F.col("shard"), F.col("block")))
    ranked = pieces.withColumn("rank", F.dense_rank().over(group.orderBy(F.col("block").isNull(), seeded, "block")))
    blocks = F.ceil(F.col("words") / BLOCK)
    times = F.least(F.lit(MOST_TIMES), F.floor(F.col("shard_quota") / blocks) + (F.col("rank") <= F.col("shard_quota") % blocks).cast("long"))
    overlap = F.least("stop", (F.col("block") + 1) * BLOCK) - F.greatest(F.col("stop") - F.col("size"), F.col("block") * BLOCK)
    part = F.when(F.col("block").isNull(), F.lit(0)).otherwise(times * overlap)
    return ranked.groupBy("source", "shard", "row", "doc_id").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(part).cast("long").alias("taken")).drop("shard", "row")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix in whole documents, with the columns of docs. A row is in it taken / size times, rounded down or up by a seeded draw of
    its own, so that a source's words come near its target: not at all, once or twice. Rows are told apart by doc_id, source and size;
    of rows that agree in these, in order of a hash of text, each gets one of the taken of such rows, the largest first, and a draw
    of its own."""
    key = ["doc_id", "source", "size"]
    held = written(taken(written(sizes(docs).select(*key), "mix-sizes")).select(*key, "taken"), "mix-taken")
    keyed = written(held.groupBy(*key).agg(F.count("*").alias("n"), F.max("taken").alias("taken")), "mix-keys")
    some = held.join(small(_renamed(keyed.where("n > 1").select(*key))), _same(key), "left_semi")
    order = Window.partitionBy(*key)
    ranked = some.withColumn("k", F.row_number().over(order.orderBy(F.desc("taken"))) - 1)
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("k") > 0, F.col("k")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}-draw|"), name)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias("times")
    pick = lambda df, *more: small(_renamed(written(df.where("size > 0 AND taken > 0").select(*key, *more, times).where("times > 0"), "mix-times")))
    rows = boxed(docs, "doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("t"))
    once = rows.join(pick(keyed.where("n = 1").withColumn("k", F.lit(0))), _same(key))
    again = rows.join(small(_renamed(keyed.where("n > 1").select(*key))), _same(key), "left_semi").withColumn("k", F.row_number().over(order.orderBy("t")) - 1)
    copies = again.join(pick(ranked, "k"), _same([*key, "k"]))
    both = once.select("row_", "times").unionByName(copies.select("row_", "times"))
    return both.select("row_", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*(F.col("row_")[c].alias(c) for c in docs.columns))


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_" for c in df.columns if c != "times"})


def _same(columns: list[str]) -> Column:
    """Null-safe equality with the columns of _renamed()."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return out


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return taken(written(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size, [{", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)}] AS v, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS i FROM d GROUP BY source),
o AS (SELECT *, {MOST_TIMES}.0::DOUBLE * size AS cap, row_number() OVER (ORDER BY {MOST_TIMES} * size / v, i) AS k, sum(size) OVER () * {SHARE_PERCENT / 100}::DOUBLE AS whole FROM s),
c AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(v) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM o),
e AS (SELECT *, max(CASE WHEN rate * v < cap THEN 1 ELSE 0 END) OVER (ORDER BY k) = 0 AS capped FROM c),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE (whole - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / sum(v) FILTER (WHERE NOT capped) OVER () * v END AS target FROM e),
n AS (SELECT *, round(sum(target) OVER () / {BLOCK})::BIGINT AS seats, sum(target) OVER () AS total, count(*) OVER () AS parties FROM t),
q AS (SELECT i, count(*) AS quota FROM (SELECT i, seats, row_number() OVER (ORDER BY w / (2 * j + 1) DESC, i) AS place FROM (SELECT i, seats, target AS w, unnest(range(0, floor(seats * target / total)::BIGINT + parties + 2)) AS j FROM n WHERE total > 0)) WHERE place <= seats GROUP BY i),
a AS (SELECT n.*, coalesce(quota, 0) AS quota FROM n LEFT JOIN q USING (i)),
h AS (SELECT d.*, a.i, a.size AS source_size, target, quota, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-' || d.size::VARCHAR)), 1, 8))::BIGINT % greatest(1, least({MOST_SHARDS}, ceil(a.size / {SHARD})))::BIGINT AS shard FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
w AS (SELECT i, shard, quota, sum(size)::DOUBLE AS words, sum(sum(size)) OVER (PARTITION BY i) AS total, count(*) OVER (PARTITION BY i) AS parties FROM h GROUP BY i, shard, quota),
y AS (SELECT i, shard, count(*) AS shard_quota FROM (SELECT i, shard, quota, row_number() OVER (PARTITION BY i ORDER BY words / (2 * j + 1) DESC, shard) AS place FROM (SELECT *, unnest(range(0, floor(quota * words / total)::BIGINT + parties + 2)) AS j FROM w WHERE total > 0)) WHERE place <= quota GROUP BY i, shard),
p AS (SELECT h.*, coalesce(shard_quota, 0) AS shard_quota, sum(size) OVER (PARTITION BY h.i, h.shard ORDER BY doc_id NULLS FIRST, size, r) AS stop, sum(size) OVER (PARTITION BY h.i, h.shard) AS words FROM h LEFT JOIN y ON y.i = h.i AND y.shard = h.shard),
b AS (SELECT *, unnest(range((stop - size)::BIGINT // {BLOCK}, (stop - 1)::BIGINT // {BLOCK} + 1)) AS block FROM p WHERE size > 0),
k AS (SELECT *, dense_rank() OVER (PARTITION BY i, shard ORDER BY md5('{SEED}|' || coalesce(source, '') || '|' || shard || '|' || block), block) AS place, ceil(words / {BLOCK})::BIGINT AS blocks FROM b),
m AS (SELECT r, sum(least({MOST_TIMES}, shard_quota // blocks + CASE WHEN place <= shard_quota % blocks THEN 1 ELSE 0 END) * (least(stop, (block + 1) * {BLOCK}) - greatest(stop - size, block * {BLOCK})))::BIGINT AS taken FROM k GROUP BY r)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM h LEFT JOIN m USING (r)
"""
