"""N-gram Jaccard self-join by vertical partitioning.

The global order of shingles is by rising (estimated) document frequency, then by hash. Documents with equal shingle sets
are one set. Each set emits the head of its shingles in that order: two sets as similar as asked share one of these, so heads
say which pairs are worth counting. These are counted vertically: the global order is cut into FRAGMENTS ranges that hold
about as many shingles each, the parts of two sets in each fragment give a partial overlap, and the sum over the fragments of
a pair decides, exactly. All fragments of a set lie in one row: a row each made eight times as many rows of the pairs.

In each group of sets that share an emitted shingle, the set that meets most others is tested against the rest; what it links
is one component. Members of other components of the group are then tested against what their size and position still allow:
one at a time while that is more than AT_ONCE comparisons and at most PEELS times, then against each other. So every link
between two components of a group is tested, components are exact, and pairs inside a component are never made.

The frequency estimate is a table of fixed width of counts over all documents; it only orders shingles, so that its errors
cost time and never a pair.

Defined results: null, empty and blank texts have no shingles, link with nothing and are components of their own; equal
rows are linked; a component without doc_id has a null component_id; very long texts are read whole, their sets being cut
into fragments; an empty table gives no rows; only doc_id and text are looked at. Shingles, sets and texts are compared by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, drop_written, forget_shuffles, pieces, table, written
from .components import components
from .shingles import shingles, texts_of

WIDTH = 1 << 22  # slots of the frequency table
BLOCKS = 64
PIECE = 8 << 20  # bytes of text that are shingled at once, more only where one text has more
FRAGMENTS = 8
#: Ids of at most so many documents are broadcast (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Nothing reads this any more: shared shingles are found in the shuffle that brings the rows of each together, at any size.
BROADCAST_KEYS = 2_000_000
#: The shingles of heads are shuffled in so many rounds, a part of all shingles each, so that only a part is on disk at once.
ROUNDS = 4
#: Comparisons of members of groups that are made at once; beyond, a further member is tested against its group first.
AT_ONCE = 50_000_000
PEELS = 6


def global_order(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each slot of the frequency table: 8 times the logarithm of the documents counted there; and the places in
    the order of such bytes and hashes at which it is cut into fragments with about as many shingles each."""
    import zstandard

    def count(batches):
        total = np.zeros(WIDTH, np.uint32)
        for b in batches:
            for part in pieces(b, 0, PIECE):
                found = [shingles(t, k) for t in texts_of(part, 0)]
                slots = np.concatenate(found or [np.zeros(0, np.uint64)]) & np.uint64(WIDTH - 1)
                if len(slots) > WIDTH // 16:
                    total += np.bincount(slots.astype(np.int64), minlength=WIDTH).astype(np.uint32)
                else:
                    at, n = np.unique(slots, return_counts=True)
                    total[at.astype(np.int64)] += n.astype(np.uint32)
        yield from packed(dict(enumerate(total.reshape(BLOCKS, -1))))

    def packed(blocks):
        z = zstandard.ZstdCompressor(level=1)
        blocks = {k: v for k, v in blocks.items() if v.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([z.compress(v.astype("<u4").tobytes()) for v in blocks.values()], pa.binary())], names=["block", "counts"])

    def add(batches):
        z, sums = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(z.decompress(raw), "<u4")
        yield from packed(sums)

    kind = "block int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).repartition(BLOCKS, "block").mapInArrow(add, kind).collect()  # BLOCKS rows, 16 MB at most
    total, z = np.zeros((BLOCKS, WIDTH // BLOCKS), np.uint32), zstandard.ZstdDecompressor()
    for r in rows:
        total[r["block"]] = np.frombuffer(z.decompress(r["counts"]), "<u4")
    ranks = np.minimum(255, 8 * np.log2(1 + total.reshape(-1).astype(np.float64))).astype(np.uint8)
    weight = np.bincount(ranks, total.reshape(-1), 256)
    before = np.concatenate([[0.0], np.cumsum(weight)])
    cuts = []
    for j in range(1, FRAGMENTS):
        at = before[-1] * j / FRAGMENTS
        r = min(int(np.searchsorted(before, at, side="right")) - 1, 255)
        part = (at - before[r]) / weight[r] if weight[r] else 0.0
        cuts.append((r << 56) + int(min(part, 1.0) * ((1 << 56) - 1)))
    return ranks, np.array(cuts, np.uint64)


def places(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The places of shingles in the global order."""
    return ranks[(h & np.uint64(WIDTH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)


def set_id(h: np.ndarray) -> int:
    """Of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def heads(docs: DataFrame, k: int, percent: int, order) -> DataFrame:
    """doc_id, t (hash of the text), n (shingles), set_id, head: the first shingles in the global order, empty where a document
    before it in its batch has the same set. order: the broadcast global_order()."""

    def emit(batches):
        ranks = order.value[0]
        for b in batches:
            for part in pieces(b, 1, PIECE):
                seen, out = set(), ([], [], [])
                for t in texts_of(part):
                    h = shingles(t, k)
                    s = set_id(h)
                    p = len(h) + (percent * -len(h)) // 100 + 1 if len(h) and s not in seen else 0
                    seen.add(s)
                    h2 = h[np.argsort(places(h, ranks), kind="stable")[:p]].view(np.int64) if p else np.zeros(0, np.int64)
                    for c, v in zip(out, (len(h), s, h2), strict=True):
                        c.append(v)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out[2])]), pa.int32()), pa.array(np.concatenate(out[2]) if out[2] else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), lists], names=["doc_id", "t", "n", "set_id", "head"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t")).mapInArrow(emit, "doc_id long, t long, n long, set_id long, head array<long>")


def fragments(docs: DataFrame, wanted: DataFrame, rows: int, nameless: bool, k: int, order) -> DataFrame:
    """set_id, frags: the shingles of the wanted (doc_id, set_id) in each fragment of the global order. Texts that share a doc_id are told apart by their sets; nameless: some documents have no doc_id, and a wanted set
    without one is looked for among them."""

    def cut(batches):
        seen, (ranks, cuts) = set(), order.value
        for b in batches:
            for piece in pieces(b, 0, PIECE):
                ids, flat, ends = [], [], [0]
                for t, of in zip(texts_of(piece, 0), piece.column(1).to_pylist(), strict=True):
                    h = shingles(t, k)
                    s = set_id(h)
                    if s in seen or of not in (None, s):
                        continue
                    seen.add(s)
                    f = np.searchsorted(cuts, places(h, ranks), side="right")
                    ids.append(s)
                    flat.append(h[np.argsort(f, kind="stable")].view(np.int64))
                    ends += (ends[-1] + np.cumsum(np.bincount(f, minlength=FRAGMENTS))).tolist()
                inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * FRAGMENTS, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), outer], names=["set_id", "frags"])

    put = F.broadcast if rows <= BROADCAST_ROWS else lambda df: df
    kind = "set_id long, frags array<array<long>>"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.join(put(wanted.where("doc_id IS NOT NULL")), "doc_id").select("text", "set_id").mapInArrow(cut, kind)
    if nameless:
        lone = docs.where("doc_id IS NULL").select("text", F.lit(None).cast("long").alias("set_id")).mapInArrow(cut, kind)
        out = out.union(lone.join(put(wanted.where("doc_id IS NULL").select("set_id")), "set_id", "left_semi"))
    return out


def _room(n: str, pos: str, percent: int) -> str:
    """The largest set with which a set of n can be as similar as asked if the first shared shingle is its pos-th."""
    return f"(({n} - {pos}) * {100 + percent} DIV {percent} - {n})"


def _fit(a: str, b: str, percent: int) -> str:
    """Whether sizes and positions let two members of a group be as similar as asked."""
    return f"{b}.n <= {_room(f'{a}.n', f'{a}.pos', percent)} AND {a}.n <= {_room(f'{b}.n', f'{b}.pos', percent)} AND 100 * {a}.n >= {percent} * {b}.n AND 100 * {b}.n >= {percent} * {a}.n"


def _head(n: str, percent: int) -> str:
    """The length of the head of a set of n."""
    return f"({n} - ({percent} * {n} + 99) DIV 100 + 1)"


def _screened(pairs: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, na, b, nb) whose heads share enough. What two sets share beyond the head that ends first is at most the
    rest of its set. keys (set_id, keys): the shingles of a head that other heads have too."""
    both = pairs.join(keys.select(F.col("set_id").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("set_id").alias("b"), F.col("keys").alias("kb")), "b")
    most = f"size(array_intersect(ka, kb)) + greatest(na - {_head('na', percent)}, nb - {_head('nb', percent)})"
    return both.where(f"{100 + percent} * ({most}) >= {percent} * (na + nb)").select("a", "na", "b", "nb")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, keys: DataFrame, k: int, percent: int, order) -> DataFrame:
    """pairs (a, na, b, nb) -> links (a, b), a table: the partial overlap of a pair is counted in each fragment, and all are summed."""
    pairs = written(_screened(pairs, keys, percent), "ngram-pairs")
    ids = written(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct(), "ngram-sets")
    rows = ids.count()
    one = sets.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    nameless = not sets.where("doc_id IS NULL").isEmpty()
    parts = written(fragments(docs, one, rows, nameless, k, order), "ngram-fragments", "uncompressed")
    whole = parts.dropDuplicates(["set_id"]) if parts.count() != rows else parts  # rows that share a doc_id, or have none
    both = pairs.join(whole.select(F.col("set_id").alias("a"), F.col("frags").alias("fa")), "a").join(whole.select(F.col("set_id").alias("b"), F.col("frags").alias("fb")), "b")
    partial = F.zip_with("fa", "fb", lambda x, y: F.size(F.array_intersect(x, y)))
    shared = both.select("a", "b", "na", "nb", F.aggregate(partial, F.lit(0), lambda n, x: n + x).alias("o"))
    links = written(shared.where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b"), "ngram-links")
    drop_written(pairs, ids, parts)
    forget_shuffles(pairs.sparkSession)
    return links


def _pairs(x: str, y: str) -> list:
    """Columns of a pair, the smaller id first."""
    first = F.col(f"{x}.set_id") < F.col(f"{y}.set_id")
    return [F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(name) for p, q, c, name in ((x, y, "set_id", "a"), (x, y, "n", "na"), (y, x, "set_id", "b"), (y, x, "n", "nb"))]


def shared_heads(sets: DataFrame, part: int) -> DataFrame:
    """set_id, n, pos, key, c: the shingles of heads that heads of other sets have too, once a set, and how many sets have each;
    of all shingles those of one round. The rows of heads are shuffled once."""
    alike = Window.partitionBy("key")
    rows = sets.select("set_id", "n", F.posexplode("head").alias("pos", "key")).where(f"pmod(key, {ROUNDS}) = {part}")
    met = rows.withColumns({"x": F.min("set_id").over(alike), "y": F.max("set_id").over(alike)}).where("x < y").drop("x", "y")
    return met.dropDuplicates(["key", "set_id"]).withColumn("c", F.count("*").over(alike))


def linked_sets(docs: DataFrame, sets: DataFrame, rounds: list[DataFrame], k: int, percent: int, order) -> DataFrame | None:
    """(id, component) of the sets that link with another set; None where there are none. rounds: shared_heads() of
    each round as a table, which is deleted."""
    members = reduce(DataFrame.unionByName, rounds)
    if members.isEmpty():
        drop_written(*rounds)
        return None
    of_set = written(members.groupBy("set_id").agg(F.sum("c").alias("score"), F.collect_list("key").alias("keys")), "ngram-set-keys")
    keys = of_set.select("set_id", "keys")
    groups = written(members.join(of_set.select("set_id", "score"), "set_id").select("key", "set_id", "n", "pos", "score"), "ngram-scored")
    drop_written(*rounds)
    forget_shuffles(docs.sparkSession)

    def lead(of: DataFrame, all_: DataFrame) -> DataFrame:
        """Pairs of each group's first of `of` with the members of all_."""
        top = of.groupBy("key").agg(F.max(F.struct("score", "set_id", "n", "pos")).alias("t")).select("key", "t.*")
        return all_.alias("x").join(top.alias("y"), "key").where("x.set_id <> y.set_id").where(_fit("x", "y", percent)).select(*_pairs("x", "y")).distinct()

    links = _verified(docs, sets, lead(groups, groups), keys, k, percent, order)
    comps = written(components(links), "ngram-components")
    done = None
    for peel in range(PEELS + 1):
        now = groups.join(small(comps.withColumnRenamed("id", "set_id")), "set_id", "left").withColumn("comp", F.coalesce("component", "set_id")).drop("component")
        by = now.groupBy("key", "comp").agg(F.count("*").alias("m"), F.min("n").alias("least"))
        main = by.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("t"), F.sum("m").alias("all"), F.count("*").alias("comps"), F.min("least").alias("least")).where("comps > 1").select("key", F.col("t.comp").alias("main"), F.col("all"), "least")
        mixed = written(now.join(main, "key"), "ngram-mixed")
        forget_shuffles(docs.sparkSession)
        rest = mixed.where("comp <> main")
        if done is not None:
            rest = rest.join(done, ["key", "set_id"], "left_anti")
        rest = written(rest.where(f"least <= {_room('n', 'pos', percent)}"), "ngram-rest")
        work = rest.agg(F.count("*"), F.sum("all")).first()
        if not work[0]:
            drop_written(rest, mixed)
            break
        last = work[1] <= AT_ONCE or peel == PEELS
        if last:
            pairs = rest.alias("x").join(mixed.alias("y"), "key").where("x.comp <> y.comp AND (y.comp = y.main OR x.set_id < y.set_id)").where(_fit("x", "y", percent)).select(*_pairs("x", "y")).distinct()
        else:
            top = rest.groupBy("key").agg(F.max_by("set_id", F.struct("score", "set_id")).alias("set_id"))
            tested = written(top if done is None else done.unionByName(top), "ngram-tested")
            if done is not None:
                drop_written(done)
            done = tested
            pairs = lead(rest, mixed)
        more = _verified(docs, sets, pairs, keys, k, percent, order)
        drop_written(rest, mixed)
        all_links = written(links.union(more), "ngram-links")
        drop_written(links, more, comps)
        links = all_links
        comps = written(components(links), "ngram-components")
        if last:
            break
    drop_written(links, groups, of_set, *([done] if done is not None else []))
    return comps


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast where it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t, n, comp for each row of docs (doc_id, text): comp names the component; t is the hash of the text."""
    docs = docs.select("doc_id", "text")
    order = docs.sparkSession.sparkContext.broadcast(global_order(docs, k))
    forget_shuffles(docs.sparkSession)
    headed = written(heads(docs, k, percent, order), "ngram-heads", "uncompressed")
    rounds = []
    for part in range(ROUNDS):
        rounds.append(written(shared_heads(headed, part), "ngram-members"))
        forget_shuffles(docs.sparkSession)
    rows = sets = written(headed.drop("head"), "ngram-all-sets")
    drop_written(headed)
    comps = linked_sets(docs, sets, rounds, k, percent, order)
    if comps is not None:
        rows = rows.join(small(comps.withColumnRenamed("id", "set_id")), "set_id", "left").withColumn("set_id", F.coalesce("component", "set_id"))
    out = written(rows.select("doc_id", "t", "n", F.col("set_id").alias("comp")), "ngram-rows")
    drop_written(sets, *([comps] if comps is not None else []))
    return out


def joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    rows = grouped(docs, k, percent)
    several = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("comp", "least")
    several = written(several, "ngram-least")
    named = rows.join(small(several.withColumn("many", F.lit(True))), "comp", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("many"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (those without doc_id last), then of the smallest hash
    of its text. Rows without words are in no component and stay. Of rows alike in doc_id and text any one is kept."""
    rows = grouped(docs, k, percent).where("n > 0")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    several = written(rows.groupBy("comp").agg(F.min(who).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("comp", "first"), "ngram-first")
    marked = rows.join(small(several), "comp").select(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_t"), (F.col("first") == who).alias("is_first"))
    gone = written(marked.groupBy("drop_id", "drop_t", "is_first").agg(F.count("*").alias("rows")).where("NOT is_first OR rows > 1"), "ngram-drop")
    held = boxed(docs, "doc_id", "text").withColumn("t", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t"))
    out = held.join(small(gone), same, "left_anti").select("row_")
    again = gone.where("is_first")
    if not again.isEmpty():  # rows alike in doc_id and text, of which one stays
        out = out.union(held.join(small(written(again, "ngram-again")), same, "left_semi").dropDuplicates(["doc_id", "text"]).select("row_"))
    return out.select("row_.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), 3, 90)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""
