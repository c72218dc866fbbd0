"""Reports: the 30-column CSV, the summary, the run log."""

from __future__ import annotations

import csv
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_rows(rows: DataFrame) -> DataFrame:
    """One row per image in order of paths; lists joined by bars, absent values empty."""
    s = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    bars = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    plain = ("image_id", "file_name", "file_path", "extension", "file_size_bytes", "width", "height", "checksum_sha256")
    return rows.orderBy("file_path").select(
        *[s(c).alias(c) for c in plain], s("source_format").alias("raw_source_format"), s("prompt").alias("prompt"), s("negative_prompt").alias("negative_prompt"), bars("character_prompts").alias("character_prompts"),
        *[s(c).alias(c) for c in ("seed", "sampler", "steps", "cfg_scale", "model", "software", "artist", "perceptual_hash", "difference_hash")],
        F.greatest(F.size(F.coalesce("embedding", F.array().cast("array<double>"))), F.lit(0)).cast("string").alias("embedding_dimensions"), s("aspect_ratio").alias("aspect_ratio"), bars("dominant_tags").alias("dominant_tags"),
        F.array_join(F.transform("categories", lambda c: c["category_label"]), "/").alias("category_path"),
        F.array_join(F.transform("categories", lambda c: F.concat(c["criterion"], F.lit(":"), c["category_label"])), "|").alias("category_results"),
        s("group_id").alias("group_id"), s("group_type").alias("group_type"), s("representative").alias("representative_image_id"), bars("issues").alias("issues"),
    )


def write_csv(path: Path, rows: DataFrame) -> None:
    """One UTF-8 file with a byte order mark, which Spark's own CSV sink does not write; rows are streamed."""
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        out.writerows(tuple(r) for r in rows.toLocalIterator())


def counted(rows: DataFrame, value: Column) -> DataFrame:
    """value, n."""
    return rows.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def value_counts(rows: DataFrame, value: Column) -> dict[str, int]:
    return {r["value"]: r["n"] for r in counted(rows, value).orderBy("value").collect()}


def summary(run: dict[str, Any], rows: DataFrame, n_groups: int, stages: dict[str, Any]) -> dict[str, Any]:
    """Counts by extension and by issue (few values each), and the counters of all stages."""
    return run | {
        "image_count": rows.count(), "group_count": n_groups, "extension_counts": value_counts(rows, F.col("extension")),
        "issue_counts": value_counts(rows, F.explode("issues")), "summary": stages,
    }


def log_line(timestamp: str, level: str, message: str, image_id: str | None = None, context: dict | None = None) -> str:
    line = f"{timestamp} [{level}] {message}" + (f" image_id={image_id}" if image_id else "")
    return line + (f" context={json.dumps(context, ensure_ascii=False, sort_keys=True)}" if context else "")
