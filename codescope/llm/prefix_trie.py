"""The trie of conversation prefixes, by chained digests.

Each conversation is its turns in order. The digest of a prefix is the SHA-256 of the digest of the prefix before and of its last
turn, so equal digests mean equal prefixes; every prefix is a row, and rows of one (depth, digest) are a node. The turns of a
conversation pass through one task in order, 32 bytes each, and nothing but the last digest is held.

A node is named by its smallest member and its depth. So the nodes named by one conversation are a path down to its end, and all
its shorter prefixes are their ancestors. For sums over subtrees, what a path holds is summed from its end upwards, and the
path's total is exploded to all ancestors above the path: at most a row a prefix, where exploding every node by itself would give
rows with the square of a conversation's length. Rows are summed before they are shuffled, and prefixes get their node by a join
that broadcasts the nodes that many conversations share.

Defined results: null roles and texts are empty; turns go null first, and equal turns in order of the digest of role and text; a
repeated turn is a turn of its own; rows without conv_id are no conversation's and are left out; a conversation without turns is a
member of the root; very long texts and conversations are taken whole; an empty table has no node, not even the root; further
columns are ignored, whatever their names. Ids within 5 of the limits of a long are not supported.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_SQL, crc32_sql, drop_written, joined_by_key, table, written

FAMILY = 5
SHARED = 9


def turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, place (from 0), t (digest of role and text), bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary") for c in ("role", "text"))
    t = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role, text), 256))
    narrow = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", t.alias("t"), F.octet_length(text).cast("long").alias("bytes"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "t")) - 1
    return narrow.select("conv_id", at.alias("place"), "t", "bytes")


def head_size(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(ordered: DataFrame) -> DataFrame:
    """turns() of conversations that begin with the first head_size turns of the first of their family, and go on with their own
    after so many: conv_id, part (0: a row a conversation, no turn; 1: from the first; 2: own), place, t, bytes. Rows of parts 1
    may name conversations that have no part 0, which don't exist."""
    own = F.struct(F.col("conv_id"), F.lit(2).alias("part"), F.col("place"), F.col("t"), F.col("bytes"))
    there = F.struct(F.col("conv_id"), F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("bytes"))
    none = F.array().cast("array<struct<conv_id:bigint,part:int,place:int,t:binary,bytes:bigint>>")
    family = F.filter(F.sequence(F.col("conv_id") - (FAMILY - 1), F.col("conv_id") + (FAMILY - 1)), lambda c: (c - c % FAMILY == F.col("conv_id")) & (F.col("place") < head_size(c)))
    given = F.transform(family, lambda c: F.struct(c.alias("conv_id"), F.lit(1).alias("part"), F.col("place"), F.col("t"), F.col("bytes")))
    parts = F.concat(
        F.when(F.col("place") == 0, F.array(there)).otherwise(none),
        F.when(F.col("place") >= head_size(F.col("conv_id")), F.array(own)).otherwise(none),
        F.when((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED - 1), given).otherwise(none),
    )
    return ordered.select(F.explode(parts).alias("x")).select("x.*")


PREFIX = "conv_id long, depth long, digest binary, bytes long, last boolean"


def prefixes(parts: DataFrame) -> DataFrame:
    """rebuilt() rows -> every prefix of every conversation that exists, the empty one too: conv_id, depth, digest, bytes (of its
    last text), last (it is the whole conversation)."""

    def run(batches):
        now, exists, digest, depth, size = None, False, b"", 0, 0
        for b in batches:
            out: list = [[], [], [], [], []]

            def emit(last: bool, out=out) -> None:  # of the batch at hand
                for column, x in zip(out, (now, depth, digest, size, last), strict=True):
                    column.append(x)

            for conv, part, _, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now or part == 0:
                    if exists:
                        emit(True)
                    now, exists, digest, depth, size = conv, part == 0, hashlib.sha256().digest(), 0, 0
                    if exists:
                        continue
                if exists:
                    emit(False)
                    digest, depth, size = hashlib.sha256(digest + t).digest(), depth + 1, n
            yield _batch(PREFIX, out)
        if exists:
            yield _batch(PREFIX, [[now], [depth], [digest], [size], [True]])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(run, PREFIX)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


#: Ids whose numbers agree but for so many last bits are joined before a node's ids meet: 1,024 at most.
NEAR_IDS = 10


def joined_digests(ends: DataFrame) -> DataFrame:
    """ends (conv_id, depth, member) -> conv_id, depth, ends_sha256: of the members, ascending, comma-joined. Members are joined in
    runs of near ids first; the runs of a node stream through one task, as its digest can only be made in order, and none is held."""
    schema = "conv_id long, depth long, ends_sha256 string"
    ids = F.transform(F.array_sort(F.collect_list("member")), lambda c: c.cast("string"))
    runs = ends.groupBy("conv_id", "depth", F.shiftright("member", NEAR_IDS).alias("run")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches):
        node, h = None, None
        for b in batches:
            out: list = [[], [], []]
            for conv, depth, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv, depth) == node:
                    h.update(b"," + text.encode())
                else:
                    if node:
                        for column, x in zip(out, (*node, h.hexdigest()), strict=True):
                            column.append(x)
                    node, h = (conv, depth), hashlib.sha256(text.encode())
            yield _batch(schema, out)
        if node:
            yield _batch(schema, [[node[0]], [node[1]], [h.hexdigest()]])

    return runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run").mapInArrow(run, schema)


def trie(every: DataFrame) -> DataFrame:
    """prefixes(), as a written table -> a row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    nodes = every.groupBy("depth", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"))
    found = joined_by_key(every, written(nodes, "trie-nodes"), ["depth", "digest"], "n_convs").select("conv_id", "depth", "node", "n_convs", "n_ends", "bytes", "last")
    named = written(found, "trie-prefixes")
    mine = F.col("node") == F.col("conv_id")
    by = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    saved, leaf = F.when(mine, (F.col("n_convs") - 1) * F.col("bytes")), F.when(mine, (F.col("n_ends") == F.col("n_convs")).cast("long"))
    # from the end upwards: a path's own nodes come first, and above it the sums stay at the path's total, null where there is no path
    run = named.select("conv_id", "depth", "node", "n_convs", mine.alias("mine"), F.lead("node").over(by).alias("parent"), F.sum(saved).over(by).alias("saved"), F.sum(leaf).over(by).alias("leaves"))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    here = F.struct(F.col("node").alias("conv_id"), F.col("depth").alias("depth"), F.when(F.col("mine"), F.col("parent")).alias("parent_conv_id"), F.when(F.col("mine"), F.col("n_convs")).alias("n_convs"), zero.alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    above = F.struct(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"), none.alias("parent_conv_id"), none.alias("n_convs"), F.lit(1).cast("long").alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    sent = run.where("saved IS NOT NULL").select(F.explode(F.when(F.col("mine") & F.col("parent").isNotNull(), F.array(here, above)).otherwise(F.array(here))).alias("x")).select("x.*")
    sums = sent.groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    ends = joined_digests(named.where("last").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    return sums.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of conversations (conv_id, turn, role, text)."""
    return trie(written(prefixes(rebuilt(turns(conversations))), "trie-digests"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH {CRC_SQL},
o AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), txt := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT conv_id, conv_id::VARCHAR AS name, own FROM o),
h AS (SELECT conv_id, own, {crc32_sql("name")} % {SHARED} AS h FROM c, crc_t),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
k AS (SELECT conv_id, len(ts) AS n, list_transform(ts, lambda x: sha256(x.role || chr(0) || x.txt)) AS ds, list_transform(ts, lambda x: octet_length(encode(x.txt))) AS bs FROM r),
p AS (SELECT conv_id, d, d = n AS last, sha256(array_to_string(ds[1:d], ',')) AS key, CASE WHEN d = 0 THEN 0 ELSE bs[d] END AS bytes, CASE WHEN d > 0 THEN sha256(array_to_string(ds[1:d - 1], ',')) END AS up FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM k)),
n AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM p GROUP BY d, key),
ch AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, key)),
m AS (SELECT p.conv_id AS member, f.* FROM p JOIN f USING (d, key)),
x AS (SELECT a.d, a.key, sum((b.n_convs - 1) * b.bytes) AS saved, count(*) FILTER (b.n_children = 0) AS leaves FROM m a JOIN m b ON a.member = b.member AND b.conv_id = b.member AND a.d <= b.d GROUP BY a.d, a.key)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN x USING (d, key) LEFT JOIN f q ON q.d = f.d - 1 AND q.key = f.up
"""
