"""Scan of a folder of image files into one row per file, with the bytes for the stages that need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import probe_column


def image_id(path: Column) -> Column:
    return F.concat(F.lit("img-"), F.substring(F.sha1(path.cast("binary")), 1, 12))


def files(spark: SparkSession, root: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """path, length, content, file_name, extension (lower case) of every file; names that begin with `_` or `.` are skipped by the source.

    With `extensions` other files are left out by the listing, so that no task reads their bytes.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if extensions:
        any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
        source = source.option("pathGlobFilter", "*{" + ",".join(map(any_case, extensions)) + "}")
    raw = source.load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = raw.select(path.alias("file_path"), F.col("length").alias("file_size_bytes"), "content")
    rows = rows.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))
    return rows.withColumn("extension", F.lower(F.regexp_extract("file_name", r"[^.](\.[^.]+)$", 1)))


def images(rows: DataFrame, extensions: list[str]) -> DataFrame:
    """Candidates by extension: id, name, path, size, dimensions, checksum, issues, content. Only candidates' headers are parsed."""
    rows = rows.where(F.col("extension").isin(*[e.lower() for e in extensions]))
    rows = rows.withColumn("probe", probe_column(F.col("extension"), F.col("content")))
    return rows.select(
        image_id(F.col("file_path")).alias("image_id"), "file_name", "file_path", "extension", "file_size_bytes", "probe.width", "probe.height",
        F.sha2("content", 256).alias("checksum_sha256"), F.col("probe.issues").alias("issues"), "content",
    )
