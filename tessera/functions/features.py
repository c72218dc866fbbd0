"""Features of an image row: aspect ratio, tags, difference hash, edge density and the local embedding, as Column builders.

`gray` is an array of rows of 0-255 values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import hash_unit

# Prompt words that hint at a style.
STYLE_CUES = (
    ("style_anime", ("anime", "illustration", "cel shading", "lineart")),
    ("style_realistic", ("photorealistic", "realistic", "photo", "cinematic")),
    ("style_painterly", ("painterly", "oil painting", "brush", "watercolor")),
    ("style_chibi", ("chibi", "super deformed")),
)


def known(width: Column, height: Column) -> Column:
    return (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(known(width, height), F.try_divide(width.cast("double"), height.cast("double")))


def basic_tags(width: Column, height: Column) -> Column:
    """[shape, size class]; empty without both dimensions."""
    area = width.cast("bigint") * height.cast("bigint")
    shape = F.when(width == height, "square").when(width > height, "landscape").otherwise("portrait")
    size = F.when(area <= 512 * 512, "resolution_small").when(area <= 1280 * 1280, "resolution_medium").otherwise("resolution_large")
    return F.when(known(width, height), F.array(shape, size)).otherwise(F.array().cast("array<string>"))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def spread_of(values: Column) -> Column:
    """Population standard deviation."""
    m = mean_of(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(values))


def enriched_tags(width: Column, height: Column, mean: Column, contrast: Column, prompt: Column) -> Column:
    """Sorted distinct tags: shape, size, tone, contrast, style cues."""
    tone = F.when(mean <= 85, "tone_dark").when(mean >= 170, "tone_bright").otherwise("tone_balanced")
    range_ = F.when(contrast <= 18, "contrast_low").when(contrast >= 55, "contrast_high").otherwise("contrast_medium")
    text = F.lower(F.coalesce(prompt, F.lit("")))
    cues = []
    for tag, words in STYLE_CUES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        cues.append(F.when(hit, tag))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(basic_tags(width, height), F.array(tone, range_, *cues)))))


def difference_hash(gray: Column) -> Column:
    """16 hex digits: 1 where a value exceeds its right neighbour, row by row (8 rows of 9)."""
    row_bits = lambda row: F.array_join(F.transform(F.slice(row, 1, F.size(row) - 1), lambda v, i: F.when(v > F.get(row, i + 1), "1").otherwise("0")), "")
    bits = F.array_join(F.transform(gray, row_bits), "")
    return F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0")


def edge_density(gray: Column, least: int = 12) -> Column:
    """Share of horizontal neighbours that differ by `least` or more."""
    steps = F.flatten(F.transform(gray, lambda row: F.transform(F.slice(row, 1, F.size(row) - 1), lambda v, i: F.abs(v - F.get(row, i + 1)))))
    return F.when(F.size(steps) > 0, F.size(F.filter(steps, lambda d: d >= least)) / F.size(steps)).otherwise(0.0)


def local_embedding(mean: Column, contrast: Column, edges: Column, ratio: Column, prompt: Column, model: Column, tags: Column, file_name: Column) -> Column:
    """Eight numbers in [0, 1]; six digits."""
    r = lambda c: F.bround(c, 6)
    return F.array(
        r(mean / 255), r(F.least(contrast / 128, F.lit(1.0))), r(edges), r(F.least(F.coalesce(ratio, F.lit(1.0)) / 4, F.lit(1.0))),
        hash_unit(prompt, "prompt"), hash_unit(model, "model"), hash_unit(F.array_join(tags, "|"), "tags"), hash_unit(F.lower(file_name), "name"),
    )
