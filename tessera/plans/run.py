"""The end-to-end run: scan, metadata, normalisation, features, classification, grouping, organisation, reports."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions import text as T
from tessera.operators import grouping
from tessera.scratch import Scratch
from tessera.sources import artifacts, demo, scan
from tessera.sources.binary import metadata_column, pixels_column

from . import embedding, organize, report
from .classify import classify, label_counts
from .normalize import normalize
from .policy import Policy


def check_paths(source: Path, output: Path) -> None:
    if not source.exists():
        raise ValueError(f"Source Root does not exist: {source}")
    if not source.is_dir():
        raise ValueError(f"Source Root is not a directory: {source}")
    if source == output:
        raise ValueError("Source Root and Output Root must be different directories.")
    if source in output.parents:
        raise ValueError("Output Root cannot be inside Source Root.")
    if output in source.parents:
        raise ValueError("Source Root cannot be inside Output Root.")


def with_metadata(images: DataFrame) -> DataFrame:
    """Embedded text of valid images; a file that cannot be read gets an issue of its own."""
    valid = F.size("issues") == 0
    # A condition does not keep a Python function from running, so invalid files hand it no bytes.
    rows = images.withColumn("_m", metadata_column(F.when(valid, F.col("extension")), F.when(valid, F.col("content"))))
    issues = F.when(F.col("_m.error").isNotNull(), F.array_append("issues", F.lit("metadata_extraction_failed"))).otherwise(F.col("issues"))
    return rows.withColumns({"issues": issues, "source_format": F.col("_m.source_format"), "raw_text": F.col("_m.raw_text"), "png_text": F.col("_m.png_text"), "exif": F.col("_m.exif")}).drop("_m")


def with_features(rows: DataFrame, resolution: embedding.Resolution) -> DataFrame:
    """Hashes, tags, embedding; drops the bytes."""
    valid = ~F.array_contains("issues", "invalid_image_header")
    rows = rows.withColumn("_x", pixels_column(F.col("extension"), F.when(valid, F.col("content")))).drop("content")
    there = F.col("_x.gray").isNotNull()
    flat = F.flatten("_x.gray")
    rows = rows.withColumns({"_mean": F.when(there, X.mean_of(flat)), "_contrast": F.when(there, X.spread_of(flat)), "_edges": F.when(there, X.edge_density(F.col("_x.gray")))})
    failed = valid & ~there
    rows = rows.withColumns({
        "issues": F.when(failed, F.array_append("issues", F.lit("feature_extraction_failed"))).otherwise(F.col("issues")), "aspect_ratio": X.aspect_ratio(F.col("width"), F.col("height")),
        "perceptual_hash": F.col("_x.perceptual_hash"), "difference_hash": F.when(there, X.difference_hash(F.col("_x.small"))),
        "dominant_tags": F.when(there, X.enriched_tags(F.col("width"), F.col("height"), F.col("_mean"), F.col("_contrast"), F.col("prompt"))).otherwise(X.basic_tags(F.col("width"), F.col("height"))),
    })
    local = F.when(there, X.local_embedding(F.col("_mean"), F.col("_contrast"), F.col("_edges"), F.col("aspect_ratio"), F.col("prompt"), F.col("model"), F.col("dominant_tags"), F.col("file_name")))
    outer = embedding.external_embedding(resolution.backend, F.col("file_path")) if resolution.backend else F.lit(None).cast("array<double>")
    rows = rows.withColumn("_outer", outer)
    rows = rows.withColumns({"embedding": F.coalesce("_outer", local), "external": F.col("_outer").isNotNull()})
    return rows.drop("_x", "_mean", "_contrast", "_edges", "_outer")


def group_input(rows: DataFrame) -> DataFrame:
    """Columns that grouping works on; the bucket is the labels of all axes but similarity."""
    path = F.transform(F.filter("categories", lambda c: c["criterion"] != "similarity"), lambda c: c["category_label"])
    return rows.select(
        "image_id", path.alias("path"), F.col("checksum_sha256").alias("checksum"), "perceptual_hash", "difference_hash", "embedding", T.tokens(F.coalesce("prompt", F.lit("")), T.GROUP_STOPWORDS).alias("tokens"),
        T.model_series(F.col("model")).alias("series"), F.size("issues").alias("n_issues"), "width", "height", F.col("file_size_bytes").alias("size"), "file_name",
    )


def with_groups(rows: DataFrame, policy: Policy, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with group columns and the similarity axis written back; groups; members."""
    limits = grouping.Thresholds(policy.similarity_threshold, float(policy.rule("prompt_family_threshold", 0.58)), float(policy.rule("visual_similarity_threshold", 0.92)))
    clustered = grouping.cascade(group_input(rows), limits, scratch)
    groups = scratch.table(grouping.numbered(clustered, scratch), "groups")
    members = scratch.table(grouping.members(clustered, groups), "members")
    rows = rows.join(members.select("image_id", "group_id", "group_type", "representative", "relation_score", "is_representative"), "image_id", "left")
    axis = policy.similarity_axis()
    if axis:
        confidence = F.when(F.col("group_type") == "unique", 0.5).when(F.col("group_type") == "visual_similar", 0.92).otherwise(1.0)
        mine = F.struct(
            F.lit(axis.priority).alias("axis_priority"), F.lit("similarity").alias("criterion"), F.col("group_id").alias("category_key"), F.col("group_id").alias("category_label"), confidence.alias("confidence"),
            F.concat(F.lit("Assigned by grouping stage as "), F.col("group_type"), F.lit(".")).alias("reason"),
        )
        others = F.filter("categories", lambda c: c["criterion"] != "similarity")
        rows = rows.withColumn("categories", F.array_sort(F.concat(others, F.array(mine))))
    return rows, groups, members


@dataclass
class Run:
    """Tables and counters of a finished run."""

    run_id: str
    started_at: datetime
    policy: Policy
    images: DataFrame
    groups: DataFrame
    members: DataFrame
    manifest: DataFrame
    summary: dict[str, Any]
    log: list[str]


def stage_counters(rows: DataFrame, backend: embedding.Resolution) -> dict[str, dict[str, Any]]:
    """Counters of metadata, normalisation and features, in one aggregation."""
    valid = ~F.array_contains("issues", "invalid_image_header")
    has = lambda c: F.count_if(F.col(c).isNotNull())
    failed = lambda name: F.count_if(F.array_contains("issues", name))
    told = rows.agg(
        has("source_format").alias("extracted"), F.count_if(valid & F.col("source_format").isNull() & ~F.array_contains("issues", "metadata_extraction_failed")).alias("missing"), failed("metadata_extraction_failed").alias("failed"), F.count_if(~valid).alias("skipped"),
        *[has(c).alias(f"with_{c}") for c in ("prompt", "negative_prompt", "seed", "model", "artist")], F.count_if(F.size("character_prompts") > 0).alias("with_character_prompts"),
        has("perceptual_hash").alias("hashed"), failed("feature_extraction_failed").alias("feature_failed"), has("embedding").alias("embedded"),
        F.count_if("external").alias("external"), F.count(F.lit(1)).alias("n"),
    ).head().asDict()
    return {
        "metadata_extraction": {f"metadata_{k}": told[k] for k in ("extracted", "missing", "failed", "skipped")}, "normalization": {k: v for k, v in told.items() if k.startswith("with_")},
        "features": {
            "processed_images": told["n"] - told["skipped"], "skipped_invalid_images": told["skipped"], "extracted_hashes": told["hashed"], "extracted_embeddings": told["embedded"],
            "external_embeddings": told["external"], "local_embeddings": told["embedded"] - told["external"], "embedding_backend": backend.provider, "requested_embedding_provider": backend.requested,
            "using_external_backend": backend.backend is not None, "failed_images": told["feature_failed"],
        },
    }


def run_pipeline(spark: SparkSession, source_root: str | Path | None, output_root: str | Path, policy: Policy | str | Path, execution_mode: str | None = None, started_at: datetime | None = None, use_demo_input: bool = False) -> Run:
    """Everything from a folder to its reports; the folder itself is never changed. With `use_demo_input` a small tree is written to it first, or beside the output."""
    if use_demo_input:
        source_root = demo.write_tree(source_root or Path(output_root).resolve().parent / "demo_input")
    if source_root is None or not str(source_root).strip():
        raise ValueError("Source Root is required unless demo input is enabled.")
    source, output = Path(source_root).resolve(), Path(output_root).resolve()
    check_paths(source, output)
    policy = (policy if isinstance(policy, Policy) else Policy.load_or_create(policy)).with_mode(execution_mode)
    started = started_at or datetime.now()
    scratch, stages, stamp = Scratch(spark, "run"), {}, started.isoformat()
    log = [report.log_line(stamp, "INFO", "Project run created for configured policy.")]

    def done(stage: str, message: str, told: dict) -> None:
        stages[stage] = told
        log.append(report.log_line(stamp, "INFO", message, context=told))

    kinds = policy.rule("supported_extensions", None) or [".png", ".jpg", ".jpeg", ".webp"]
    images = scan.images(scan.files(spark, str(source), policy.include_subdirectories, kinds), kinds)
    backend = embedding.resolve(policy.extra_rules)
    # One projection over one read; what follows works on rows without the bytes.
    rows = scratch.table(with_features(normalize(with_metadata(images)), backend), "images")
    visited = scan.files(spark, str(source), policy.include_subdirectories).select("file_path").count()  # names alone, no bytes
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("issues", "invalid_image_header")).alias("bad")).head()
    done("scan", "Scan stage completed.", {"visited_files": visited, "candidate_files": told["n"], "valid_images": told["n"] - told["bad"], "skipped_files": visited - told["n"], "invalid_images": told["bad"]})
    for k, v in stage_counters(rows, backend).items():
        done(k, f"{k} stage completed.", v)
    if backend.warning:
        log.append(report.log_line(stamp, "WARNING", backend.warning))
    rows = scratch.table(classify(rows, policy, scratch, keep_families=True), "classified")
    families = rows.agg(
        F.count(F.lit(1)).alias("processed_images"), F.count_if(F.size("categories") > 0).alias("classified_images"),
        F.countDistinct("style_family").alias("auto_style_families"), F.countDistinct("character_family").alias("auto_character_families"),
    ).head().asDict()
    rows = rows.drop("style_family", "character_family")
    rows, groups, members = with_groups(rows, policy, scratch)
    rows = scratch.table(rows, "grouped")
    counts: dict[str, dict[str, int]] = {}
    for r in label_counts(rows).orderBy("criterion", "label").collect():
        counts.setdefault(r["criterion"], {})[r["label"]] = r["n"]
    done("classification", "Classification stage completed.", families | {"by_criterion": counts})
    kinds = report.value_counts(groups, F.col("group_type"))
    told = {"bucket_count": groups.select("path").distinct().count(), "group_count": sum(kinds.values())} | {f"{k}_groups": kinds.get(k, 0) for k in grouping.PASSES}
    done("grouping", "Grouping stage completed.", told | {"by_group_type": kinds})

    output.mkdir(parents=True, exist_ok=True)
    sorted_root = output / "Sorted"
    planned = organize.destinations(rows, policy, organize.existing_files(spark, sorted_root) if sorted_root.exists() else None)
    # The plan is written before any file is copied: a task that runs again finds the same names.
    planned = scratch.table(planned, "planned")
    placed = scratch.table(organize.materialize(planned, policy, sorted_root), "placed")
    entries = organize.manifest(placed, sorted_root)
    organized = {"execution_mode": policy.execution_mode, "sorted_root": str(sorted_root), "manifest_path": str(output / "manifest.json")} | organize.counters(placed)
    header = {"run_id": f"run-{started:%Y%m%d-%H%M%S}", "project_name": "tessera", "generated_at": stamp, "execution_mode": policy.execution_mode, "sorted_root": str(sorted_root), "entry_count": stages["scan"]["candidate_files"]}
    organize.write_manifest(output / "manifest.json", header, entries)
    done("organization", "Output organization stage completed.", organized)
    report.write_csv(output / "report.csv", report.report_rows(placed))
    about = {"run_id": header["run_id"], "project_name": "tessera", "source_root": str(source), "output_root": str(output), "started_at": stamp, "status": "completed"}
    summary = report.summary(about, placed, sum(kinds.values()), stages)
    (output / "summary.json").write_text(json.dumps(summary, indent=2, ensure_ascii=False), encoding="utf-8")
    log.append(report.log_line(stamp, "INFO", "Report generation completed."))
    (output / "run.log").write_text("\n".join(log) + "\n", encoding="utf-8")
    return Run(header["run_id"], started, policy, placed, groups, members, entries, summary, log)


def payload(run: Run, output_root: str | Path) -> dict[str, Any]:
    """What a front end shows of a run that has just ended."""
    return artifacts.payload(output_root) | {"project_run": {"run_id": run.run_id, "started_at": run.started_at.isoformat(), "policy": run.policy.to_dict(), "summary": run.summary}}
