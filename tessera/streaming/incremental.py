"""Incremental scan: new image files of a folder since the last call, by Structured Streaming with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import scan

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def new_images(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """Streaming image rows (as `scan.images`, without the bytes)."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", recursive).load(root)
    rows = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.col("length").alias("file_size_bytes"), "content")
    rows = rows.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))
    rows = rows.withColumn("extension", F.lower(F.regexp_extract("file_name", r"[^.](\.[^.]+)$", 1)))
    return scan.images(rows, extensions).drop("content")


def append_new(spark: SparkSession, root: str, table: str, checkpoint: str, extensions: list[str]) -> int:
    """Process what is there now, exactly once, into Parquet under `table`; returns rows of the table."""
    stream = new_images(spark, root, extensions)
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table).count()
