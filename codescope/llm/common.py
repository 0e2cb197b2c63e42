"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The bytes that separate words: space and \x09-\x0D.
WORD_SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where that is unset and all runs in this one
    process, a temporary folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codescope-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


#: Paths made by scratch(), in order, that weren't dropped.
_made: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing is created."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> list[str]:
    """The paths that scratch() gave out and that weren't dropped."""
    return list(_made)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes paths given out by scratch() that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _made:
            _made.remove(path)


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and it survives the loss of executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def running(df: DataFrame, tag: str, order: list[str], **sums: str) -> DataFrame:
    """df with place (from 0) in a total order, and for each of sums the total of that column over the rows before. Rows are
    sorted by range into a table in the shared folder, and what lies before each range is added up first."""
    at = F.monotonically_increasing_id()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", at), tag).withColumn("range_", F.shiftright("at_", 33))
    inner, outer = Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("range_").agg(F.count("*").alias("place"), *(F.sum(c).alias(k) for k, c in sums.items()))
    before = ranges.select("range_", *(F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"{c}_") for c in ("place", *sums)))  # a row a range
    own = {"place": F.shiftright(F.shiftleft("at_", 31), 31), **{k: F.coalesce(F.sum(c).over(inner), F.lit(0)) for k, c in sums.items()}}
    return rows.join(F.broadcast(before), "range_").select(*df.columns, *((F.col(f"{k}_") + v).alias(k) for k, v in own.items()))


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        drop_paths(df.sparkSession, [df.scratch_path])


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to
    collect its garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def boxed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """All columns of docs as the struct row_, beside those asked for, so that no name that an operator adds can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), *columns)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return let(F.trim(F.coalesce(text, F.lit("")), F.lit(WORD_SEPARATORS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SEPARATOR_RE)))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batch, column: int, most: int):
    """An Arrow batch in runs of rows with about so many bytes of a text column, at least one row each."""
    import numpy as np
    import pyarrow as pa

    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = texts.buffers()[1]
    ends = np.frombuffer(raw, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if raw and len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def filesystem(uri: str):
    """The file system and path of a URI or plain path, for use on executors."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write) -> int:
    """Writes a file under its final name in one go; write gets the open stream. Returns its size."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        write(out)
        return out.tell()


def attempt_name(prefix: str) -> str:
    """A file name that no other task or attempt of a task uses."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{prefix}-{c.partitionId():06d}-{c.taskAttemptId()}" if c else f"{prefix}-{uuid.uuid4().hex}"


#: Keys that hold more than one in so many of all rows are hot; there are fewer of them than that.
HOT_SHARE = 10_000


def joined_by_key(rows: DataFrame, mapping: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows inner-joined to mapping, which has one row a key and in count how many of rows have that key; keys aren't null. The
    hot keys, fewer than HOT_SHARE, are broadcast, so that the rows of none of them meet in one task; the others go by shuffle.
    Both tables are read twice."""
    total = mapping.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    few = mapping.where(hot)
    return rows.join(F.broadcast(few), keys).unionByName(rows.join(F.broadcast(few.select(keys)), keys, "left_anti").join(mapping.where(~hot), keys))


#: SQL: a table crc_t with the one row tab, the 256 entries of the reflected CRC-32 of polynomial 0xEDB88320.
CRC_SQL = "crc_t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i)))"


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of a not empty text, beside crc_t."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
