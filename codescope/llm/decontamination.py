"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

Test items are short and documents long, so their Jaccard similarity says nothing; sought is containment, the share of an
item's shingles that a document has. Items are partitioned by size, in powers of two. All items of a partition have MinHash
signatures of one length: their smallest hash values, as many as the largest item of the partition may lack, and EXTRA more.
The hits of a signature in a document estimate containment: a document that has threshold of an item of q shingles lacks
q - ceil(threshold * q) of them at most, so it has at least the rest of the signature. Pairs with so many hits are
candidates, among which no such document is missing, and exact containment decides them.

Words are those between white space, lower-cased in A-Z; an item of fewer words than a shingle is one shingle of all its
words, and documents are then cut into runs of that many words too.

Defined results: null, empty and blank texts and items have no shingles and match nothing; repeated document rows give
each pair once; documents without doc_id are told apart by text; equal items match alike; a containment of exactly the
threshold counts; very long texts are read whole; an empty table on either side gives no match; only doc_id and text,
item_id and text are looked at, and without_contaminated() keeps further columns, whatever their names. Shingles, and texts
that share a doc_id, are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, let, table, word_array, written

WORDS = 5
THRESHOLD_PERCENT = 80
EXTRA = 3
#: Signatures and candidates of at most so many rows are broadcast (some 40 bytes a row), and items of at most five times as
#: many shingles (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def runs(words: Column, k: int) -> Column:
    """The hashes of all runs of k words, in order."""
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))))


def document_runs(text: Column, sizes: list[int]) -> Column:
    return let(word_array(ascii_lower(text)), lambda w: F.array_distinct(F.concat(*(runs(w, k) for k in sizes))))


def item_shingles(benchmark: DataFrame, words: int) -> DataFrame:
    """item_id, k (words in a shingle), shingles (distinct hashes): one row an item that has words."""
    cut = benchmark.select("item_id", word_array(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    whole = F.array(F.coalesce(*(F.when(F.size("w") == k, F.xxhash64(*(F.get(F.col("w"), F.lit(j)) for j in range(k)))) for k in range(1, words)), F.lit(0)))
    return cut.select("item_id", F.least(F.size("w"), F.lit(words)).alias("k"), F.when(F.size("w") < words, whole).otherwise(F.array_distinct(runs(F.col("w"), words))).alias("shingles"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def signatures(items: DataFrame, percent: int) -> DataFrame:
    """items (item_id, shingles) -> item_id, partition (of sizes from 2 ** partition on), need (hits), signature."""
    lacked = lambda q: F.floor(q * (100 - percent) / 100).cast("int")
    q = F.size("shingles")
    sized = items.where(q > 0).select("item_id", "shingles", F.floor(F.log2(q)).cast("int").alias("partition"))
    most = F.pow(F.lit(2), F.col("partition") + 1) - 1
    cut = sized.select("item_id", "partition", lacked(q).alias("lacked"), F.slice(F.array_sort("shingles"), F.lit(1), lacked(most) + 1 + EXTRA).alias("signature"))
    return cut.select("item_id", "partition", (F.size("signature") - F.col("lacked")).alias("need"), "signature")


def candidates(hashed: DataFrame, sketch: DataFrame) -> DataFrame:
    """hashed (doc_id, t, h: a distinct shingle), sketch (item_id, need, h) -> the (doc_id, t, item_id) with enough hits."""
    hits = hashed.join(sketch, "h").groupBy("doc_id", "t", "item_id").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
    return hits.where("hits >= need").select("doc_id", "t", "item_id")


def matches(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, t (hash of the text), item_id, n_item_shingles, n_shared: the pairs of at least percent containment."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).where("text IS NOT NULL")
    items = written(item_shingles(benchmark, words), "decontamination-items")
    sizes = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()] or [words]  # at most words of them
    q = F.size("shingles")
    sketch = written(signatures(items, percent).select("item_id", "need", F.explode("signature").alias("h")), "decontamination-signatures")
    held = items.agg(F.coalesce(F.sum(q), F.lit(0))).first()[0]
    hashed = docs.select("doc_id", "t", F.explode(document_runs(F.col("text"), sizes)).alias("h"))
    pairs = written(candidates(hashed, small(sketch, sketch.count())), "decontamination-candidates")
    n = pairs.count()
    same = lambda d: F.col("doc_id").eqNullSafe(d["i"]) & (F.col("t") == d["u"])
    found = small(pairs.select(F.col("doc_id").alias("i"), F.col("t").alias("u")).distinct(), n)
    again = docs.join(found, same(found), "left_semi").dropDuplicates(["doc_id", "t"])
    named = small(pairs.select(F.col("doc_id").alias("i"), F.col("t").alias("u"), "item_id"), n)
    sets = again.select("doc_id", "t", document_runs(F.col("text"), sizes).alias("has")).join(named, same(named)).select("doc_id", "t", "has", "item_id")
    whole = sets.join(small(items, held // 5), "item_id").select("doc_id", "t", "item_id", q.cast("long").alias("n_item_shingles"), F.size(F.array_intersect("shingles", "has")).cast("long").alias("n_shared"))
    return whole.where(100 * F.col("n_shared") >= percent * F.col("n_item_shingles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared: the pairs in which the document has at least percent of the item's shingles."""
    lone = F.when(F.col("doc_id").isNull(), F.col("t")).alias("lone")
    return matches(docs, benchmark, **how).groupBy("doc_id", lone, "item_id").agg(F.max("n_item_shingles").alias("n_item_shingles"), F.max("n_shared").alias("n_shared")).drop("lone")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents of docs that contain no item, with the columns of docs."""
    hits = written(matches(docs, benchmark, **how).select(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_t")).distinct(), "decontamination-hits")
    held = boxed(docs, "doc_id", F.xxhash64("text").alias("t"))
    return held.join(small(hits, hits.count()), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("t") == F.col("hit_t")), "left_anti").select("row_.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


ORACLE_SQL = f"""
WITH iw AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), {WORDS}) AS k, unnest(range(1, greatest(len(w) - {WORDS}, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
size AS (SELECT item_id, count(*) AS q FROM ish GROUP BY item_id),
dw AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ish) WHERE len(w) >= k))
SELECT doc_id, item_id, q::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared FROM dsh JOIN ish USING (k, s) JOIN size USING (item_id) GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= {THRESHOLD_PERCENT} * q
"""
