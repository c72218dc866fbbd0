"""Character prompts from text that holds JSON somewhere: recursive key search, which JSON paths of SQL cannot express, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that hold prompts, and the text keys that are taken as they are.
PROMPT_KEYS = frozenset(("char_caption", "char_captions", "char_prompt", "char_prompts", "character_prompt", "character_prompts"))
DIRECT_KEYS = ("character_prompt", "character prompts", "character_prompts", "char_prompt", "char_prompts", "char_caption", "char_captions")


def parts(text: str) -> Iterator[str]:
    """Prompts of a string: split at line breaks and bars, trimmed, white space collapsed."""
    for p in re.split(r"\n+|\s*\|\s*", text):
        if p := re.sub(r"\s+", " ", p.strip(" ,;")):
            yield p


def documents(text: str) -> Iterator[Any]:
    """Whatever parses as JSON of the whole text, its outermost braces, its outermost brackets."""
    text = text.strip()
    tried = dict.fromkeys([text] + [text[a : b + 1] for o, c in ("{}", "[]") if 0 <= (a := text.find(o)) < (b := text.rfind(c))])
    for t in tried:
        try:
            yield json.loads(t)
        except (ValueError, RecursionError):
            continue


def prompts_in(value: Any, wanted: bool = False) -> Iterator[str]:
    """Strings under prompt keys, in document order. Below such a key lists are taken whole, objects are searched again."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from prompts_in(v, k.lower().replace("-", "_").replace(" ", "_") in PROMPT_KEYS)
    elif isinstance(value, list):
        for v in value:
            yield from prompts_in(v, wanted)
    elif wanted and isinstance(value, str):
        yield from parts(value)


def character_prompts_of(entries: list[dict], extra: list[str | None]) -> list[str]:
    """Prompts of direct keys, then of JSON in any value or extra text; without case-insensitive repeats."""
    texts = {}
    for e in entries:
        texts[e["key"]] = e["value"]
    found = [p for k in DIRECT_KEYS if texts.get(k) for p in parts(texts[k])]
    for t in [*texts.values(), *(t for t in extra if t)]:
        if "{" in t or "[" in t:
            for d in documents(t):
                found += prompts_in(d)
    first: dict[str, str] = {}
    for p in found:
        first.setdefault(p.casefold(), p)
    return list(first.values())


def character_prompts(entries: Column, *extra: Column) -> Column:
    """array<string> from a column of text entries and further texts."""

    @F.pandas_udf("array<string>")
    def run(entries: pd.Series, extra: pd.Series) -> pd.Series:
        return pd.Series([character_prompts_of([] if e is None else list(e), [] if x is None else list(x)) for e, x in zip(entries, extra)])

    return run(entries, F.array(*extra) if extra else F.array().cast("array<string>"))
