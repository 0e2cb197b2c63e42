"""Sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = T.StructType([T.StructField("ID", T.LongType()), T.StructField("code", T.StringType()), T.StructField("language", T.StringType()), T.StructField("generator", T.StringType()), T.StructField("label", T.IntegerType())])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def resolve_source(spark: SparkSession, paths: list[str]) -> str:
    """The first path (or glob) that exists, on any file system that Spark reads."""
    for path in paths:
        fs, p = _fs(spark, path)
        if len(fs.globStatus(p) or []):
            return path
    raise FileNotFoundError(f"none of {paths}")


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Files, folders or globs as one table; columns that some lack are null there."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(*paths)


def cached_parquet(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; where there is none, make() is written there first."""
    fs, p = _fs(spark, path)
    if not fs.exists(_fs(spark, f"{path}/_SUCCESS")[1]):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def conform(df: DataFrame, schema: T.StructType = SAMPLES, required: tuple[str, ...] = ("code",)) -> DataFrame:
    """Exactly the columns of schema; missing ones are null, missing required ones an error; id in any case is ID."""
    names = {c.lower(): c for c in df.columns}
    if lacking := [c for c in required if c.lower() not in names]:
        raise ValueError(f"columns missing: {lacking}; there are {df.columns}")
    return df.select(*((F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def ensure_id(df: DataFrame, order: list[str], name: str = "ID") -> DataFrame:
    """df with an id: id in any case renamed, else a number from 0 in the given order, ties by a hash of the row, so the same rows get
    the same numbers whatever the partitioning. Rows are sorted once, by ranges over all these keys (selection.running), so that
    no task has more than its share, also where first keys are equal."""
    for c in df.columns:
        if c.lower() == name.lower():
            return df.withColumnRenamed(c, name)
    from ..operators.selection import running

    kept = [F.col(f"`{c}`") for c in df.columns]
    return running(df, [*(F.col(f"`{c}`") for c in order), F.xxhash64(*kept)]).select(F.col("_place").alias(name), *kept)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def submission_table(df: DataFrame) -> DataFrame:
    """A test table conformed for submission: ID (id in any case) and code, both required."""
    return conform(df, T.StructType([T.StructField("ID", T.LongType()), T.StructField("code", T.StringType())]), ("ID", "code"))


def labelled_test(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first labelled test sample that exists, conformed; code and label are required, rows that lack one are left out."""
    return conform(read_parquet(spark, resolve_source(spark, paths)), required=("code", "label")).where("code IS NOT NULL AND label IS NOT NULL")


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """CSV with a header, sorted over its files; one file where single is asked for (then one task writes all rows)."""
    df = df.orderBy(*order) if order else df
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def label_map(spark: SparkSession, text: str) -> DataFrame:
    """A JSON object of names to ids, or of ids to names, as (label, name)."""
    pairs = json.loads(text).items()
    rows = [(int(k), str(v)) if str(k).lstrip("-").isdigit() else (int(v), str(k)) for k, v in pairs]
    return spark.createDataFrame(sorted(rows), "label int, name string")


def write_arrays(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Vectors, graphs and probability rows: Parquet with array columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def dealt(df: DataFrame, by: str, amount: int, per: int) -> DataFrame:
    """df by a hash of by, with about per of amount (rows or bytes of the whole) in a partition, so that what a task holds doesn't grow
    with the table; in more partitions than a shuffle of the session has: where there are as many, Spark keeps those of a
    shuffle by the same key before, and may coalesce them."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, -(-amount // per)), by)


def materialised(df: DataFrame, tag: str = "table") -> DataFrame:
    """df as a table in the folder that driver and executors share (spark.checkpoint.dir; a temporary one only on a local master where
    that is unset): read many times, computed once, and safe from the loss of executors. The folder's owner clears it."""
    import re
    import uuid

    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codescope-"))
        where = spark.sparkContext.getCheckpointDir()
    path = f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
