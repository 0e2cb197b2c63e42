"""Resampling of documents towards a target by importance of hashed n-grams, over a table of word positions.

Every document's words are laid out by posexplode as one row a position; window lead() within a document brings the following
words beside each, and their concatenation gives the n-grams of each order that begin there. A feature's bucket is its crc32
modulo BUCKETS. The positions are written once, in buckets alone; counts by bucket over all documents and over all target texts
give each bucket a gain (the logarithm of how much more frequent it is in the target), and gains are joined back to the
positions and averaged by document. Documents of MIN_WORDS words are drawn without replacement by adding Gumbel noise, a hash of
doc_id, to the weight, and taking the highest scores.

Texts are dealt to tasks by row once; the window needs no further shuffle, and counts are summed before theirs. There are at
most BUCKETS buckets, so gains are broadcast. The drawing sorts narrow rows by range.

Defined results: null, empty and wordless texts have no features, weight 0 and no rank; rows that share a doc_id are documents
of their own, told apart by row and with the same noise; the noise of a row without doc_id is that of an empty id, and in ties it
comes first; equal scores go by doc_id, then by n_features, then by row; very long texts are read whole (the words of one
document are sorted in one task, on disk where memory lacks); an empty corpus gives no rows, an empty target counts of zero;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_SQL, ascii_lower, crc32_sql, drop_written, running, table, written

ORDERS = 2
BUCKETS = 10_000
MIN_WORDS = 20
DRAW_PERCENT = 25
SEED = 7
#: What separates words, after lower-casing of A-Z: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def positions(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, *keys: str) -> DataFrame:
    """docs (text and keys) -> keys, row (a row of docs), b1 to b{orders}: the bucket of the run of so many words that begins at
    a position, null where the text ends before. A row a word, and one of nulls for a text without words."""
    words = F.array_remove(F.split(ascii_lower(F.col("text")), GAP), "")
    dealt = docs.select(*keys, F.monotonically_increasing_id().alias("row"), "text").repartition("row")
    at = dealt.select(*keys, "row", F.posexplode_outer(words).alias("pos", "w1"))
    by = Window.partitionBy("row").orderBy("pos")
    ahead = at.select(*keys, "row", "w1", *(F.lead("w1", k - 1).over(by).alias(f"w{k}") for k in range(2, orders + 1)))
    grams = [F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *(f"w{j}" for j in range(1, k + 1)))) for k in range(1, orders + 1)]
    return ahead.select(*keys, "row", *((F.crc32(g.cast("binary")) % buckets).cast("int").alias(f"b{k}") for k, g in enumerate(grams, 1)))


def bucket_counts(at: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, name): how many features of all orders a bucket has. At most a row a bucket."""
    one = [at.select(F.col(f"b{k}").alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n")) for k in range(1, orders + 1)]
    both = one[0]
    for more in one[1:]:
        both = both.unionByName(more)
    return both.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """own (bucket, s), target (bucket, t) -> (bucket, gain), a row a bucket."""
    every = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(own, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"])
    all_ = Window.partitionBy()  # a row a bucket
    s, t, of_s, of_t = F.col("s"), F.col("t"), F.sum("s").over(all_), F.sum("t").over(all_)
    return both.select("bucket", F.floor(1000 * F.log(((t + 1) * (of_s + buckets)).cast("double") / ((s + 1) * (of_t + buckets)).cast("double"))).alias("gain"))


def weights(at: DataFrame, gain: DataFrame, orders: int, *keys: str) -> DataFrame:
    """keys, row, n_words, n_features, weight: the floored mean of the gains of a row's features, 0 where it has none."""
    for k in range(1, orders + 1):
        at = at.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    n = sum((F.count(f"b{k}") for k in range(2, orders + 1)), F.count("b1"))
    total = sum((F.coalesce(F.sum(f"g{k}"), F.lit(0)) for k in range(2, orders + 1)), F.coalesce(F.sum("g1"), F.lit(0)))
    by = at.groupBy(*keys, "row").agg(F.count("b1").alias("n_words"), n.alias("n_features"), total.alias("total"))
    return by.select(*keys, "row", "n_words", "n_features", F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.floor(F.col("total") / F.col("n_features"))).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel variable that hangs on seed and id alone, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = DRAW_PERCENT, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_features, weight, score, rank (null: not drawn): a row a row of docs."""
    at = written(positions(docs, orders, buckets, "doc_id"), "positions")
    gain = gains(bucket_counts(at, orders, "s"), bucket_counts(positions(target, orders, buckets), orders, "t"), buckets)
    scored = written(weights(at, gain, orders, "doc_id").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    drop_written(at)
    drawn = scored.where(F.col("n_words") >= min_words).count() * percent // 100
    ranked = running(scored.where(F.col("n_words") >= min_words).withColumn("down", -F.col("score")), "resampling-order", ["down", "doc_id", "n_features", "row"])
    out = lambda df, rank: df.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    return out(ranked, F.when(F.col("place") < drawn, F.col("place") + 1)).unionByName(out(scored.where(F.col("n_words") < min_words), F.lit(None)))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _features_sql(name: str, key: str) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"{name}_w AS (SELECT {key}, {words} AS w FROM {name}), {name}_f AS (SELECT {key}, unnest(w) AS f FROM {name}_w UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_w)"


ORACLE_SQL = f"""
WITH {CRC_SQL}, {_features_sql("documents", "doc_id")}, {_features_sql("benchmark", "item_id")},
known AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM documents_f UNION SELECT f FROM benchmark_f), crc_t),
s AS (SELECT bucket, count(*) AS s FROM documents_f JOIN known USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM benchmark_f JOIN known USING (f) GROUP BY bucket),
g AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM range({BUCKETS}) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM documents_f JOIN known USING (f) JOIN g USING (bucket) GROUP BY doc_id),
d AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents_w LEFT JOIN w USING (doc_id)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n >= {MIN_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * {DRAW_PERCENT} // 100 FROM r) THEN rank END::BIGINT AS rank FROM e LEFT JOIN r USING (doc_id)
"""
