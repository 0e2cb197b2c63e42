"""A stateless stream of texts through features to Parquet: an extension for inference in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def feature_stream(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 8) -> StreamingQuery:
    """New files under source are read, so many a batch, transformed and appended to sink; what is there is done once, then it stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
