"""Similarity of sets, hashes and vectors as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays without repeats; 0 where one is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def hash_bits(hex_digits: Column) -> Column:
    """16 hex digits as a signed 64-bit number; null for null or empty."""
    return F.conv(F.nullif(hex_digits, F.lit("")), 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 64-bit numbers; 64 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def combined_distance(pa: Column, da: Column, pb: Column, db: Column) -> Column:
    return (hamming(pa, pb) + hamming(da, db)) / 2


def hash_similarity(distance: Column) -> Column:
    """1 - d / 64, not below 0, four digits (ties are exact binary ties, so half-even is Python's rounding)."""
    return F.bround(F.greatest(F.lit(0.0), 1 - distance / 64), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for missing vectors, different lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
