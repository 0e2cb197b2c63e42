"""Fitted tables (vocabularies, idf weights, scalers) that are kept with what they were fitted by, and tables cached by what they
were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import _fs

VERSION = 1


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, what: dict) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    finally:
        stream.close()


def save_fitted(df: DataFrame, path: str, kind: str, **settings) -> None:
    """Writes a fitted table, and last a manifest of its kind, version, settings and schema; without that there is no table."""
    spark = df.sparkSession
    fs, p = _fs(spark, f"{path}/manifest.json")
    fs.delete(p, False)
    df.write.mode("overwrite").parquet(f"{path}/table")
    _write(spark, f"{path}/manifest.json", {"kind": kind, "version": VERSION, "settings": settings, "schema": df.schema.simpleString(), "rows": spark.read.parquet(f"{path}/table").count()})


def load_fitted(spark: SparkSession, path: str, kind: str, **settings) -> DataFrame:
    """The table at path; an error where there is none, or where its kind, version, settings or rows aren't those asked for."""
    m = _read(spark, f"{path}/manifest.json")
    if m is None:
        raise FileNotFoundError(f"no fitted table at {path}")
    want = {"kind": kind, "version": VERSION, "settings": json.loads(json.dumps(settings))}
    if wrong := {k: (m.get(k), v) for k, v in want.items() if m.get(k) != v}:
        raise ValueError(f"the table at {path} was fitted otherwise: {wrong}")
    df = spark.read.parquet(f"{path}/table")
    if df.schema.simpleString() != m["schema"] or df.count() != m["rows"]:
        raise ValueError(f"the table at {path} isn't what its manifest says")
    return df


def cache_key(vocabulary: DataFrame | None = None, **settings) -> str:
    """A name for all that a cached table hangs on: the version, settings, and the first 50 entries of a vocabulary."""
    head = [list(r) for r in vocabulary.orderBy("type_id").limit(50).select("type", "type_id").collect()] if vocabulary is not None else []
    return hashlib.md5(json.dumps([VERSION, settings, head], sort_keys=True).encode()).hexdigest()


def cached_chunks(samples: DataFrame, path: str, key: str, build, id_: str = "ID", chunk_rows: int = 100_000) -> DataFrame:
    """build(samples), with a column sample_id, from the cache at path and key, in chunks by a hash of the sample's id. Chunks that are
    missing, or whose files aren't those of the manifest, are built anew, in one job, and the others are left alone. Another key is
    another cache, so a changed setting rebuilds; so does another number of samples, as it names other chunks."""
    spark, n = samples.sparkSession, samples.count()
    chunks = max(1, -(-n // chunk_rows))
    at = f"{path}/{key}-{n}-{chunks}"
    known = (_read(spark, f"{at}.json") or {}).get("chunks", {})
    of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(chunks)).cast("int")
    lost = [k for k in range(chunks) if str(k) not in known or _files(spark, f"{at}/chunk={k}") != known[str(k)]]
    if lost:
        for k in lost:
            fs, p = _fs(spark, f"{at}/chunk={k}")
            fs.delete(p, True)
        part = samples if len(lost) == chunks else samples.where(of(id_).isin(lost))
        build(part).withColumn("chunk", of("sample_id")).repartition("chunk").write.mode("append").partitionBy("chunk").parquet(at)
        known = {str(k): _files(spark, f"{at}/chunk={k}") for k in range(chunks)}
        _write(spark, f"{at}.json", {"key": key, "chunks": known})
    return spark.read.parquet(at).drop("chunk")


def _files(spark: SparkSession, path: str) -> list:
    """Names and sizes of a chunk's files; none where all its samples have no rows."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted([f.getPath().getName(), f.getLen()] for f in fs.listStatus(p) if not f.getPath().getName().startswith((".", "_")))
