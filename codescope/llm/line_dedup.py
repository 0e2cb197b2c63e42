"""Deletion of repeated line runs by a suffix array over line ids.

A document is the sequence of its lines that have a word; a line's id is its hash. The suffixes that begin with a line that
occurs again (in a stretch of such lines of at least WORDS words) are ordered by prefix doubling: a rank by the first k lines, and the line and rank k lines further on, give the
rank by 2k lines. A rank is the place in the array of the first suffix that begins alike; suffixes that nothing else begins
like are settled and leave. The longest common prefix of neighbours is found from the ranks of all rounds, the largest first.
Suffixes between which no longest common prefix is below L are an interval, and share their first L lines.

Every maximal run of repeated lines of at least WORDS words is the union of its shortest such runs, from each line forward
and from each line back; where the interval of such a run has an earlier member (by doc_id, then line), the run's lines are
deleted. As each line has a word, no run longer than WORDS lines needs to be looked up, so the array is built to that depth.

Defined results: null, empty and blank texts have no lines; lines without a word are never deleted; rows that share a doc_id
are told apart in order of text, so the later of two equal rows loses its lines; rows without doc_id come last; very long
texts are read whole; an empty table gives no rows; further columns are kept by without_repeats().
Lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, drop_written, pieces, running, table, written

WORDS = 50
AT = ["none", "doc_id", "copy"]  # a document; none: without doc_id
KEY = "none boolean, doc_id long, copy long, i int"
PIECE = 4 << 20  # bytes of text that are cut at once, more only where one text has more
#: Tables of at most so many rows (8 to 40 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast where it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def rounds(words: int) -> list[int]:
    """How many lines each round ranks by: powers of two, two of which hold any run of words lines."""
    return [1 << k for k in range(max(1, words.bit_length()))]


def lines(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, copy, text) -> none, doc_id, copy, i (among lines with a word), line_no, h, n (words), fwd, back: how many lines
    from this one on, or up to it, first have so many words (0: all of them have fewer); ahead: the h of the lines so far on as a
    round ranks by, null past the end."""
    steps = rounds(words)

    def cut(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            for part in pieces(b, 2, PIECE):
                cols: list = [[] for _ in range(8)]
                ahead: list = []
                for doc_id, copy, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    kept = [(k, x, n) for k, x in enumerate((raw or b"").split(b"\n")) if (n := len(x.split()))]
                    if not kept:
                        continue
                    total = np.concatenate([[0], np.cumsum([n for _, _, n in kept])])
                    m = len(kept)
                    end = np.searchsorted(total, total[:-1] + words)
                    begin = np.searchsorted(total, total[1:] - words, side="right") - 1
                    at = np.arange(m)
                    h = [xxh3_64_intdigest(x) - (1 << 63) for _, x, _ in kept]
                    for c, v in zip(cols, ([doc_id] * m, [copy] * m, at.tolist(), [k for k, _, _ in kept], h, [n for _, _, n in kept], np.where(end <= m, end - at, 0).tolist(), np.where(begin >= 0, at + 1 - begin, 0).tolist()), strict=True):
                        c.extend(v)
                    past = h + [None] * steps[-1]
                    ahead += [past[k + s] for k in range(m) for s in steps]
                n = len(cols[0])
                ids = pa.array(cols[0], pa.int64())
                flat = [ids.is_null(), ids.fill_null(0), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(steps), pa.int32()), pa.array(ahead, pa.int64()))
                yield pa.RecordBatch.from_arrays([*flat, lists], names=[*AT, "i", "line_no", "h", "n", "fwd", "back", "ahead"])

    return docs.select(F.col("doc_id").cast("long"), F.col("copy").cast("long"), "text").mapInArrow(cut, KEY + ", line_no int, h long, n int, fwd int, back int, ahead array<long>")


def stretches(live: DataFrame, words: int) -> DataFrame:
    """Of lines that occur again, those in a stretch of such lines, one after the other, of so many words or more: no run that
    counts has others. A document's lines are counted up along it, so only narrow rows are sorted, by document."""
    along = Window.partitionBy(*AT).orderBy("i")
    apart = live.withColumn("stretch", F.col("i") - F.row_number().over(along))
    return apart.withColumn("held", F.sum("n").over(Window.partitionBy(*AT, "stretch"))).where(F.col("held") >= words).drop("stretch", "held")


def ranked(live: DataFrame, words: int) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """live (document, i, h, ahead) -> for each round (k, the suffixes whose first k lines begin another suffix too, with their
    rank), and all suffixes with their last rank."""
    first = written(running(live.groupBy("h").agg(F.count("*").alias("c")), "suffix-order", ["h"], r="c").select("h", "r"), "suffix-ranks")
    now = written(live.join(small(first), "h").select(*AT, "i", "ahead", "r"), "suffix-ranks")
    open_, settled = [], []
    for place, k in enumerate(rounds(words)):
        open_.append((k, now))
        if 2 * k > rounds(words)[-1]:
            break
        later = reduce(DataFrame.unionByName, settled, now.select(*AT, "i", "r")).select(*AT, (F.col("i") - k).alias("i"), F.col("r").alias("r2"))
        pairs = now.join(later, [*AT, "i"], "left").select(*AT, "i", "ahead", "r", F.get("ahead", F.lit(place)).alias("h2"), F.coalesce("r2", F.lit(-1)).alias("r2"))
        pairs = written(pairs, "suffix-pairs")
        groups = running(pairs.groupBy("r", "h2", "r2").agg(F.count("*").alias("c")), "suffix-order", ["r", "h2", "r2"], before="c")
        groups = written(groups, "suffix-groups")
        start = written(groups.groupBy("r").agg(F.min("before").alias("start")), "suffix-starts")
        new = written(groups.join(small(start), "r").select(F.col("r").alias("r1"), F.col("h2").alias("g2"), F.col("r2").alias("s2"), (F.col("r") + F.col("before") - F.col("start")).alias("new"), (F.col("c") > 1).alias("more")), "suffix-new")
        both = pairs.join(small(new), (F.col("r") == F.col("r1")) & F.col("h2").eqNullSafe(F.col("g2")) & (F.col("r2") == F.col("s2"))).select(*AT, "i", "ahead", F.col("new").alias("r"), "more")
        both = written(both, "suffix-ranks")
        settled.append(both.where("NOT more").select(*AT, "i", "r"))
        now = both.where("more").drop("more")
        drop_written(pairs, groups, start, new)
    return [(k, t.select(*AT, "i", "r")) for k, t in open_], reduce(DataFrame.unionByName, settled, now.select(*AT, "i", "r"))


def suffix_array(live: DataFrame, words: int) -> DataFrame:
    """The suffixes in order: document, i, place, lcp (lines shared with the suffix before, 0 where that begins otherwise)."""
    open_, whole = ranked(live, words)
    order = written(running(whole, "suffix-array", ["r", *AT, "i"]), "suffix-array")
    names = [*AT, "i"]
    before = order.select((F.col("place") + 1).alias("place"), *(F.col(c).alias(f"{c}_b") for c in names))
    pairs = order.select("place", *names).join(before, "place").withColumn("lcp", F.lit(0))
    for k, t in reversed(open_):
        here = lambda suffix: t.select(*(F.col(c).alias(f"{c}{suffix}" if c != "i" else f"at{suffix}") for c in names), F.col("r").alias(f"r{suffix}"))  # noqa: B023, E731
        pairs = pairs.withColumn("at_a", F.col("i") + F.col("lcp")).withColumn("at_b", F.col("i_b") + F.col("lcp"))
        a, b = here("_a").withColumnsRenamed({f"{c}_a": c for c in AT}), here("_b")
        met = pairs.join(a, [*AT, "at_a"], "left").join(b, [*(f"{c}_b" for c in AT), "at_b"], "left")
        pairs = written(met.select("place", *names, *(f"{c}_b" for c in names), F.when(F.col("r_a") == F.col("r_b"), F.col("lcp") + k).otherwise(F.col("lcp")).alias("lcp")), "suffix-lcp")
    return order.select("place", *names).join(pairs.select("place", "lcp"), "place", "left").na.fill(0, ["lcp"])


def intervals(array: DataFrame, words: int) -> DataFrame:
    """array (document, i, place, lcp, depths: numbers of lines) -> document, i, l, interval: a row a depth; suffixes of the same
    l and interval share their first l lines. An interval is named by how often lcp was below l up to it: that is counted for
    each depth and range of the array first (words numbers a range, added up by the driver), then within a range."""
    n = int(array.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_range = array.repartitionByRange(n, "place").withColumn("range_", F.spark_partition_id())
    rows = written(by_range, "suffix-intervals").groupBy("range_")
    chunk = 10_000

    def below(lcp: np.ndarray) -> np.ndarray:
        return lcp[:, None] < np.arange(1, words + 1)[None, :]

    def counted(t: pa.Table) -> pa.Table:
        lcp, total = t.column("lcp").to_numpy(), np.zeros(words, np.int64)
        for lo in range(0, len(lcp), chunk):
            total += below(lcp[lo : lo + chunk]).sum(0)
        return pa.table({"range_": t.column("range_").slice(0, 1), "n": pa.array([total.tolist()], pa.list_(pa.int64()))})

    total, before = np.zeros(words, np.int64), {}
    for r in sorted(rows.applyInArrow(counted, "range_ int, n array<long>").collect()):
        before[r["range_"]] = total
        total = total + np.array(r["n"])

    def named(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        lcp, at, out = t.column("lcp").to_numpy(), before[t.column("range_")[0].as_py()], []
        for lo in range(0, len(lcp), chunk):
            names = np.cumsum(below(lcp[lo : lo + chunk]), 0) + at
            at = names[-1]
            part = t.slice(lo, chunk).combine_chunks()
            depths = part.column("depths").combine_chunks()
            flat = depths.flatten().to_numpy()
            of = np.repeat(np.arange(part.num_rows), np.diff(depths.offsets.to_numpy()))
            out.append(part.select([*AT, "i"]).take(pa.array(of)).append_column("l", pa.array(flat, pa.int32())).append_column("interval", pa.array(names[of, flat - 1], pa.int64())))
        return pa.concat_tables(out)

    return rows.applyInArrow(named, KEY + ", l int, interval long")


def repeated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs (doc_id, copy, text) -> doc_id, copy, line_no of the lines to delete."""
    all_ = written(lines(docs, words), "suffix-lines")
    again = written(all_.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-again")
    live = written(stretches(all_.join(small(again), "h"), words).drop("n"), "suffix-live")
    drop_written(all_, again)
    runs = live.select(*AT, "i", F.explode(F.array(F.struct(F.col("i").alias("s"), F.col("fwd").alias("l")), F.struct((F.col("i") - F.col("back") + 1).alias("s"), F.col("back").alias("l")))).alias("x")).where("x.l > 0")
    depths = runs.select(*AT, F.col("x.s").alias("i"), "x.l").groupBy(*AT, "i").agg(F.collect_set("l").alias("depths"))  # words of them at most
    named = written(intervals(suffix_array(live, words).join(depths, [*AT, "i"], "left").withColumn("depths", F.coalesce("depths", F.array().cast("array<int>"))), words), "suffix-runs")
    who = F.struct(*AT, "i")
    shared = written(named.groupBy("l", "interval").agg(F.min(who).alias("first"), F.count("*").alias("n")).where("n > 1").select("l", "interval", "first"), "suffix-shared")
    hit = named.join(small(shared), ["l", "interval"]).where(who > F.col("first"))
    covered = hit.select(*AT, F.explode(F.sequence("i", F.col("i") + F.col("l") - 1)).alias("i")).distinct()
    out = covered.join(live.select(*AT, "i", "line_no"), [*AT, "i"])
    return out.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "copy", "line_no")


def with_copies(docs: DataFrame) -> DataFrame:
    """docs with `copy`, which tells rows that share a doc_id apart, in order of text; 0 where none do."""
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not twice:
        return docs.withColumn("copy", F.lit(0).cast("long"))
    return running(docs, "suffix-copies", ["doc_id", "text"]).withColumnRenamed("place", "copy")


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs, its columns kept, with the later copies of repeated line runs deleted from text."""
    held = with_copies(boxed(docs, "doc_id", "text"))
    gone = repeated(held.select("doc_id", "copy", "text"), words).groupBy("doc_id", "copy").agg(F.collect_set("line_no").alias("deleted"))
    gone = small(written(gone, "suffix-deleted")).withColumnsRenamed({"doc_id": "d", "copy": "c"})
    marked = held.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")
    kept = F.concat_ws("\n", F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains("deleted", k)))
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(kept)
    return marked.select(F.col("row_").withField("text", text).alias("row_")).select("row_.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    narrow = docs.select("doc_id", "copy", size.cast("long").alias("n_lines"))
    gone = repeated(docs).groupBy("doc_id", "copy").agg(F.count("*").alias("n_deleted"), F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("deleted"))
    gone = gone.withColumnsRenamed({"doc_id": "d", "copy": "c"})
    met = narrow.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")
    return met.select("doc_id", "n_lines", F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"), F.coalesce("deleted", F.lit("")).alias("deleted"))


ORACLE_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM t),
b AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n FROM a),
l AS MATERIALIZED (SELECT doc_id, line, line_no, n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM b WHERE n > 0),
f AS (SELECT doc_id, i AS s, i AS e, n AS w, line AS run FROM l UNION ALL SELECT f.doc_id, s, l.i, w + n, run || chr(10) || line FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = e + 1 WHERE w < {WORDS}),
g AS (SELECT doc_id, i AS s, i AS e, n AS w, line AS run FROM l UNION ALL SELECT g.doc_id, l.i, e, w + n, line || chr(10) || run FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = s - 1 WHERE w < {WORDS}),
r AS (SELECT DISTINCT doc_id, s, e, run FROM (SELECT * FROM f UNION ALL SELECT * FROM g) WHERE w >= {WORDS}),
m AS (SELECT *, min((doc_id, s)) OVER (PARTITION BY run) AS first FROM r),
x AS (SELECT DISTINCT m.doc_id, line_no FROM m JOIN l ON l.doc_id = m.doc_id AND l.i BETWEEN s AND e WHERE (m.doc_id, s) > first),
y AS (SELECT doc_id, count(*) AS n_deleted, string_agg(line_no, ',' ORDER BY line_no) AS deleted FROM x GROUP BY doc_id)
SELECT documents.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(deleted, '') AS deleted FROM documents LEFT JOIN y USING (doc_id)
"""
