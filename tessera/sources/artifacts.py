"""Artifacts of an earlier run: manifest, summary, report and log."""

from __future__ import annotations

import csv
import json
from itertools import islice
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _json(path: Path) -> Any:
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


def payload(output_root: str | Path, limit: int = 20) -> dict[str, Any]:
    """What a front end shows: JSON documents, the first rows of the report, the last lines of the log."""
    root = Path(output_root)
    report, log, rows, lines = root / "report.csv", root / "run.log", [], []
    if report.exists():
        with report.open(encoding="utf-8-sig", newline="") as f:
            rows = list(islice(csv.DictReader(f), limit))
    if log.exists():
        lines = log.read_text(encoding="utf-8").splitlines()[-limit:]
    return {"project_run": None, "manifest": _json(root / "manifest.json"), "summary_file": _json(root / "summary.json"), "report_preview": rows, "run_log_preview": lines}


def manifest(spark: SparkSession, output_root: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(f"{output_root}/manifest.json").selectExpr("inline(entries)")


def report(spark: SparkSession, output_root: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{output_root}/report.csv")
