"""Optional external embeddings: a backend hook, loaded once per worker, with the local embedding as fallback."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PACKAGES = ("torch", "transformers", "PIL")


class Backend:
    """What an embedding provider implements; instances travel to the workers before they load anything."""

    name = "external"

    def extract_embedding(self, path: str) -> list[float]:
        raise NotImplementedError


class ClipBackend(Backend):
    name = "transformers_clip"

    def __init__(self, config: dict[str, Any]):
        self.config, self.loaded = config, None

    @staticmethod
    def is_available() -> bool:
        return all(importlib.util.find_spec(p) for p in PACKAGES)

    def extract_embedding(self, path: str) -> list[float]:
        import torch
        from PIL import Image
        from transformers import AutoModel, AutoProcessor

        device = str(self.config.get("device") or "cpu")
        if self.loaded is None:
            name = str(self.config.get("model_id") or "openai/clip-vit-base-patch32")
            self.loaded = AutoProcessor.from_pretrained(name), AutoModel.from_pretrained(name).to(device).eval()
        processor, model = self.loaded
        with torch.no_grad():
            v = model.get_image_features(**processor(images=Image.open(path).convert("RGB"), return_tensors="pt").to(device))
            v = getattr(v, "pooler_output", v)
        if self.config.get("normalize_embeddings", True):
            v = torch.nn.functional.normalize(v, dim=-1)
        return [round(float(x), 6) for x in v[0].cpu()]


@dataclass(frozen=True)
class Resolution:
    backend: Backend | None
    provider: str
    requested: str
    warning: str | None = None


def resolve(rules: dict[str, Any]) -> Resolution:
    """The backend that the rules ask for, or none with the reason."""
    config = dict(rules.get("external_model") or {})
    asked = str(config.get("provider") or "auto")
    if not config.get("enabled", False):
        return Resolution(None, "local_heuristic", asked)
    if asked not in ("auto", ClipBackend.name):
        return Resolution(None, "local_heuristic", asked, f"Unsupported external model provider '{asked}'. Falling back to local heuristic embedding.")
    if not ClipBackend.is_available():
        return Resolution(None, "local_heuristic", asked, f"External model backend requested, but required packages are missing: {', '.join(PACKAGES)}.")
    return Resolution(ClipBackend(config), ClipBackend.name, asked)


def external_embedding(backend: Backend, path: Column) -> Column:
    """array<double>, null where the backend fails on a file."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for paths in batches:
            out = []
            for p in paths:
                try:
                    out.append(backend.extract_embedding(p) or None)
                except Exception:  # noqa: BLE001 - any failure of a provider means the fallback
                    out.append(None)
            yield pd.Series(out)

    return run(path)
