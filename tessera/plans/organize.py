"""Output plan: relative paths from labels, collision-free names, materialisation by the executors, the manifest."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sanitize_segment
from tessera.operators.ranking import rename_collisions

from .policy import Policy


def existing_files(spark: SparkSession, sorted_root: Path) -> DataFrame:
    """folder, file_name of what an earlier run left under the root."""
    found = [(os.path.relpath(d, sorted_root), f) for d, _, names in os.walk(sorted_root) for f in names]
    return spark.createDataFrame(found, "folder string, file_name string")


def destinations(rows: DataFrame, policy: Policy, existing: DataFrame | None) -> DataFrame:
    """`rows` with folder (of sanitized labels) and resolved file name, in order of names."""
    labels = F.transform(F.col("categories"), lambda c: sanitize_segment(c["category_label"]))
    folder = F.when(F.size(labels) > 0, F.array_join(labels, "/")).otherwise(sanitize_segment(F.lit(policy.unclassified_handling)))
    rows = rows.withColumns({"folder": folder, "_order": F.lower("file_name")})
    return rename_collisions(rows, "folder", "file_name", ["_order", "image_id"], existing).drop("_order")


def copied(source: str, target: str) -> bool:
    """Whether an earlier attempt of the same task has made this copy: size and time of the source, which a copy keeps."""
    if not os.path.exists(target):
        return False
    a, b = os.stat(source), os.stat(target)
    return (a.st_size, int(a.st_mtime)) == (b.st_size, int(b.st_mtime))


def materialize(rows: DataFrame, policy: Policy, sorted_root: Path) -> DataFrame:
    """`rows` with action, status and error. Executors copy; a file that is already there in full is left, so a task may run again."""
    mode, root = policy.execution_mode, str(sorted_root)
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, folder, name in zip(pdf["file_path"], pdf["folder"], pdf["resolved"]):
                try:
                    target = os.path.join(root, folder, name)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    if mode == "copy" and not copied(source, target):
                        # Under another name until it is whole, so an attempt that dies leaves nothing that looks finished.
                        part = f"{target}.{uuid.uuid4().hex}.part"
                        shutil.copy2(source, part)
                        os.replace(part, target)
                    out.append((mode, "copied" if mode == "copy" else mode, None))
                except OSError as e:
                    out.append((mode, "failed", str(e)))
            yield pdf[columns].assign(action=[x[0] for x in out], status=[x[1] for x in out], error=pd.Series([x[2] for x in out], dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", action string, status string, error string"
    return rows.mapInPandas(run, schema)


def manifest(rows: DataFrame, sorted_root: Path) -> DataFrame:
    """One entry per row."""
    relative = F.concat(F.lit("Sorted/"), F.col("folder"), F.lit("/"), F.col("resolved"))
    return rows.select(
        "image_id", "file_name", F.col("file_path").alias("source_path"), F.concat(F.lit(f"{sorted_root}/"), F.col("folder"), F.lit("/"), F.col("resolved")).alias("output_path"), relative.alias("relative_output_path"),
        "action", "status", F.transform("categories", lambda c: c["category_label"]).alias("category_path"), "group_id", F.coalesce("group_type", F.lit("unique")).alias("group_type"),
        F.coalesce("is_representative", F.lit(False)).alias("is_representative"), "error",
        F.when(F.col("error").isNotNull(), F.array_append("issues", F.lit("organization_failed"))).otherwise(F.col("issues")).alias("issues"),
    )


def count(rows: DataFrame) -> DataFrame:
    """The stage's counters as one row."""
    renamed = F.col("resolved") != F.col("file_name")
    return rows.agg(
        F.countDistinct("folder").alias("directories_touched"), *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("copied", "moved", "analyze_only", "failed")],
        F.count_if(renamed).alias("collision_renamed_files"), F.count_if(renamed & F.col("met_existing")).alias("preserved_existing_files"),
    )


def counters(rows: DataFrame) -> dict[str, int]:
    return count(rows).head().asDict()


def write_manifest(path: Path, header: dict, entries: DataFrame) -> None:
    """A single JSON file, streamed entry by entry in order of names."""
    with path.open("w", encoding="utf-8") as f:
        f.write(json.dumps(header, indent=2, ensure_ascii=False)[:-2] + ',\n  "entries": [')
        comma = ""
        for row in entries.orderBy(F.lower("file_name"), "image_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            f.write(f"{comma}\n    {row['j']}")
            comma = ","
        f.write("\n  ]\n}\n")
