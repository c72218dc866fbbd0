"""Normalised metadata: one projection over the raw maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.json_search import character_prompts

PARAMETER_KEYS = ("parameters", "prompt", "description", "imagedescription", "usercomment")
COMMENT_KEYS = ("comment", "xpcomment", "notes")


def normalize(df: DataFrame) -> DataFrame:
    """`df` (raw_text, png_text: maps; source_format; exif strings are in raw_text already) with the normalised fields."""
    keep = df.columns
    rows = df.withColumn("_e", T.text_entries(F.col("raw_text"), F.col("png_text")))
    rows = rows.withColumns({"_p": T.pick_first(F.col("_e"), *PARAMETER_KEYS), "_c": T.pick_first(F.col("_e"), *COMMENT_KEYS)})
    e, p, c = F.col("_e"), F.col("_p"), F.col("_c")
    rows = rows.withColumns({
        "prompt": T.prompt_of(p), "negative_prompt": T.negative_prompt_of(p), "character_prompts": character_prompts(e, p, c),
        "seed": T.int_from(e, ("seed",), p, c), "sampler": T.string_from(e, ("sampler",), p, c), "steps": T.int_from(e, ("steps",), p, c).cast("int"),
        "cfg_scale": T.float_from(e, ("cfg scale", "cfg_scale", "cfg"), p, c), "model": T.string_from(e, ("model",), p, c), "software": T.string_from(e, ("software",), p, c),
        "artist_raw": T.string_from(e, ("artist", "artists"), p, c),
    })
    rows = rows.withColumn("artist", T.clean_artist(F.col("artist_raw")))
    keys = F.array_sort(F.map_keys("raw_text"))
    extra = F.struct(
        "source_format", keys.alias("raw_text_keys"), c.alias("comment"), "artist_raw",
        F.when(F.col("artist_raw").isNotNull(), F.col("artist").isNull()).alias("artist_is_null"), T.style_signature(F.col("prompt"), F.col("artist")).alias("style_signature"),
    )
    fields = ["prompt", "negative_prompt", "character_prompts", "seed", "sampler", "steps", "cfg_scale", "model", "software", "artist"]
    return rows.select(*keep, *fields, extra.alias("extra"))
