"""A corpus pipeline of five stages over documents, each written as Parquet and read again before the next.

Defined results, of every stage: documents with null, empty or blank text fail the quality rules and go; rows without doc_id
are told apart by text and pass through like others; rows that repeat a doc_id and its text are one document to the join,
which keeps one of them; rows that share a doc_id and differ in text are different documents; very long texts are read whole;
an empty table gives an empty table; further columns are carried along, whatever their names."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from codescope.llm import decontamination, mixing, ngram_join, quality_rules, token_output
from codescope.llm.common import drop_paths, made, scratch, table


#: Tables in the shared folder that stages left behind, by the stage's place.
_left: dict[int, list[str]] = {}


def stage(place: int):
    """A stage of this place. As each stage is written before the next begins, what the stages before it left in the shared
    folder is no longer read, and is deleted."""

    def put(f):
        @wraps(f)
        def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for k in [k for k in _left if k < place]:
                drop_paths(spark, _left.pop(k))
            before = set(made())
            out = f(spark, docs, sf_dir)
            _left.setdefault(place, []).extend(x for x in made() if x not in before)
            return out

        return staged

    return put


@stage(0)
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject."""
    return quality_rules.keep_good(docs)


@stage(1)
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of at least 0.8 of five-word shingles."""
    return ngram_join.one_of_each(docs, 5, 80)


@stage(2)
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of the five-word shingles of every benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage(3)
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


@stage(4)
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32, shard."""
    return token_output.tokenise(spark, docs)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("token output", token_ids),
]

#: Tokens can't be made in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_paths(spark, [before])
        before = path
    return docs
