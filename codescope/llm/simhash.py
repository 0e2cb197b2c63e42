"""Near duplicates by SimHash fingerprints, found by meeting in the middle.

A document's fingerprint has 64 bits, one where over half of its shingles' hashes have one. Every distinct fingerprint emits all
variants within half the radius, itself included, and variants are shuffled: two fingerprints within the radius have a variant in
common, and only such within twice half the radius can. In each ball (the fingerprints that emitted one variant, never more than
a ball has points, whatever the data) every fingerprint is paired with the smallest; the pairs are deduplicated and verified by
counting differing bits. With an even radius all of a ball are within the radius of each other, so no link is lost by that. With
an odd one they needn't be, and all pairs of a ball are verified.

Documents are fingerprinted where they lie, and only (doc_id, fingerprint) goes on. Fingerprints that many documents share are one
fingerprint in the search, and their documents get the component by a join that broadcasts what is hot.

Defined results: null, empty and blank texts have no words and fingerprint zero, which links like any other; fewer words than a
shingle are one shingle; rows that share a doc_id each get their own fingerprint; a row without doc_id has one too, and a
component all of whose rows lack it has a null component_id; very long texts are hashed whole, in pieces; an empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, joined_by_key, pieces, table, written
from .components import components
from .shingles import texts_of

WORDS = 3
RADIUS = 2
SEED = 42
BATCH = 4 << 20  # bytes of text that are looked at at once, more only where one text has more
HASHES = 1 << 14  # hashes whose bits are counted at once


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Of a UTF-8 text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    n = len(found)
    if n < words:
        return xxh64_intdigest(b" ".join(found), seed) if n else 0
    line = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts, stops = (ends[: n - words + 1] - np.fromiter(map(len, found[: n - words + 1]), np.int64, n - words + 1) - 1).tolist(), (ends[words - 1 :] - 1).tolist()
    total, count = np.zeros(64, np.int64), len(starts)
    for lo in range(0, count, HASHES):
        h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[lo : lo + HASHES], stops[lo : lo + HASHES], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the fingerprint's bits as a signed long): a row a row of docs."""

    def run(batches):
        for b in batches:
            for part in pieces(b, 1, BATCH):
                fps = np.fromiter((fingerprint(t, words, seed) for t in texts_of(part)), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(bits: int) -> list[int]:
    """All signed 64-bit numbers with at most so many ones; 0 comes first."""
    every = (sum(1 << k for k in c) for n in range(bits + 1) for c in combinations(range(64), n))
    return [m - (1 << 64) if m >> 63 else m for m in every]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps (fp), distinct -> (a, b), distinct, a < b: pairs that differ in at most radius bits, enough to connect all such pairs,
    and with an odd radius all of them. What is shuffled is a variant and the number of the mask that made it."""
    by = F.array(*(F.lit(m).cast("long") for m in masks((radius + 1) // 2)))
    sent = fps.select("fp", by.alias("masks")).select("fp", F.posexplode("masks").alias("k", "m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), F.col("k").cast("short").alias("k"))
    met = sent.repartition("variant").select("variant", F.col("variant").bitwiseXOR(F.get(by, F.col("k").cast("int"))).alias("fp"))
    ball = Window.partitionBy("variant")
    if radius % 2:
        both = met.withColumn("all", F.collect_list("fp").over(ball)).select(F.explode("all").alias("a"), F.col("fp").alias("b"))  # a ball is bounded
    else:
        both = met.withColumn("a", F.min("fp").over(ball)).select("a", F.col("fp").alias("b"))
    return both.where("a < b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id that links reach)."""
    own = written(fingerprints(docs, words, seed), "simhash")
    known = written(own.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "simhash-known")
    pairs = written(links(known.select("fp"), radius), "simhash-links")
    linked = components(pairs)
    placed = known.join(linked.select(F.col("id").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(joined_by_key(placed, written(least.join(placed.groupBy("component").agg(F.count("*").alias("members")), "component"), "simhash-components"), ["component"], "members").select("fp", "n", "component_id"), "simhash-named")
    drop_written(known, pairs)
    return joined_by_key(own, named, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
