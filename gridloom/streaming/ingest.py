"""Incremental reading of documents, once per content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as they arrive, with a hash of their content."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).load(path)
    return files.withColumn("content_hash", F.sha2("content", 256))


def ingest(files: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Parses each content that was not seen within ``delay`` and appends the result to ``target``."""
    once = files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["content_hash"])
    return parse(once).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
