from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.json_search import character_prompts_of


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(c.alias("r")).head()["r"]


def test_prompt_and_negative(spark):
    cases = {
        "a cat\nNegative prompt: bad, worse\nSteps: 20": ("a cat", "bad, worse"), "a cat\nSteps: 20, Seed: 3": ("a cat", None), "oversize: huge": ("over", None),
        "Negative prompt: x": (None, "x"), "a NEGATIVE PROMPT:": ("a", ""), "  \n": (None, None),
    }
    for t, want in cases.items():
        assert (one(spark, T.prompt_of(F.col("t")), t=t), one(spark, T.negative_prompt_of(F.col("t")), t=t)) == want, t


def test_numbers(spark):
    big = 2**64 - 1
    entries = F.array(F.struct(F.lit("seed").alias("key"), F.lit(f"about {big}").alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    assert int(one(spark, T.int_from(entries, ("seed",)))) == big
    assert int(one(spark, T.int_from(none, ("seed",), F.lit(f"Seed: {big}")))) == int(float(big))  # running text goes through a double
    assert one(spark, T.float_from(none, ("cfg scale", "cfg"), F.lit("CFG: 6.5"))) == 6.5
    assert one(spark, T.int_from(none, ("seed",), F.lit('{"seed": 1}'))) is None


def test_last_entry_wins(spark):
    a = F.create_map(F.lit("Comment"), F.lit(" one "), F.lit("x"), F.lit("  "))
    b = F.create_map(F.lit("COMMENT"), F.lit("two"))
    entries = T.text_entries(a, b)
    assert one(spark, T.pick_first(entries, "x", "comment")) == "two"


def test_labels(spark):
    assert one(spark, T.slugify(F.lit("  Größe / 7 "))) == "gr_e_7"
    assert one(spark, T.slugify(F.lit("은발"))) == "unknown"
    assert one(spark, T.label_token(F.lit("sample artist"))) == "sample_artist"
    assert one(spark, T.sanitize_segment(F.lit(" a/b. "))) == "a_b"
    assert one(spark, T.model_series(F.lit("모델_Diffusion V4.5"))) == "모델-diffusion-v4"
    assert one(spark, T.model_series(F.lit("nai-diffusion-v4"))) == "nai-diffusion"
    assert one(spark, T.clean_artist(F.lit(' "Null" '))) is None


def test_nested_json_prompts():
    comment = 'x {"v4_prompt": {"caption": {"char_captions": [{"char_caption": "silver hair, red eyes"}, {"char_caption": "SILVER hair, red eyes"}, {"char_caption": "blue hair|green"}]}}}'
    assert character_prompts_of([{"key": "comment", "value": comment}], []) == ["silver hair, red eyes", "blue hair", "green"]
    assert character_prompts_of([{"key": "comment", "value": "{broken"}], [None]) == []


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60))
def test_split_prompts_is_python_split(t):
    from tessera.functions.json_search import parts

    assert list(parts(t)) == [p for p in (re.sub(r"\s+", " ", x.strip(" ,;")) for x in re.split(r"\n+|\s*\|\s*", t)) if p]
