"""Text functions as Column builders: built-in expressions only, so projections stay in generated code.

White space is Python's (`str.isspace`), which neither Java's \\s nor its (?U) form matches exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that str.isspace() accepts.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
INT = r"[-+]?\d+"
FLOAT = r"[-+]?\d+(?:\.\d+)?"

# Words that carry no meaning in prompts, one list for each use.
SIGNATURE_STOPWORDS = ("best", "quality", "masterpiece", "high", "low", "girl", "boy", "solo", "portrait", "character")
FAMILY_STOPWORDS = ("best", "quality", "masterpiece", "high", "low", "very", "with", "and", "the", "for", "from", "null")
GROUP_STOPWORDS = ("best", "quality", "masterpiece", "high", "low")
STYLE_DROP = ("girl", "boy", "solo", "character", "person", "face", "portrait")
CHARACTER_DROP = ("anime", "illustration", "realistic", "photorealistic", "cinematic", "painterly", "painting", "watercolor", "lineart", "style", "artist")
NO_ARTIST = ("null", "none", "unknown", "n/a")

FIELD_LABELS = "Steps|Sampler|CFG scale|Seed|Model|Size"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def literal(s: str) -> str:
    """A string as a Java regex that matches just it."""
    return "".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in s)


def text_entries(*maps: Column) -> Column:
    """Several text maps as one array of (key, value): keys lower, values stripped, blanks dropped; later entries outrank earlier ones."""
    each = [F.transform(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), strip(e["value"]).alias("value"))) for m in maps]
    return F.filter(F.concat(*each), lambda e: e["value"].isNotNull() & (e["value"] != ""))


def pick_first(entries: Column, *keys: str) -> Column:
    """Value of the first key that has one; of repeated keys the last entry counts."""

    def last(key: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["key"] == key.lower()), F.lit(-1))["value"]

    return F.coalesce(*map(last, keys))


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def prompt_of(parameters: Column) -> Column:
    """Text before a `Negative prompt:` (or all), cut at the first field label; null if nothing is left."""
    t = strip(parameters)
    head = strip(F.regexp_extract(t, r"(?ius)\A(.*?)(?:Negative prompt:|\z)", 1))
    return blank_to_null(strip(F.regexp_replace(head, rf"(?ius)\n?(?:{FIELD_LABELS}):.*\z", "")))


def negative_prompt_of(parameters: Column) -> Column:
    """Text between `Negative prompt:` and the next field line; null where there is no such label, empty where nothing follows it."""
    t = strip(parameters)
    found = F.regexp_extract(t, rf"(?ius)Negative prompt:{WS}*(.*?)(?:\n(?:{FIELD_LABELS}):|\z)", 1)
    return F.when(t.rlike(r"(?iu)Negative prompt:"), strip(found))


def search_number(text: Column, label: str, pattern: str = INT) -> Column:
    """Digits after `label` and a colon or equals sign, as a string; null if there are none. No word boundary is asked for."""
    return blank_to_null(F.regexp_extract(text, rf"(?iu){literal(label)}{WS}*[:=]{WS}*({pattern})", 1))


def search_string(text: Column, label: str) -> Column:
    """Rest of the line up to a comma after `label` and a colon or equals sign."""
    pattern = rf"(?iu){literal(label)}{WS}*[:=]{WS}*([^\n,]+)"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def number_in(value: Column, pattern: str = INT) -> Column:
    return blank_to_null(F.regexp_extract(value, f"({pattern})", 1))


def exact_integer(d: Column) -> Column:
    """The whole number that a double is, up to 2^95; Spark's own cast takes the shortest decimal digits instead."""
    high = F.floor(d / 4294967296.0)
    low = (d - high.cast("double") * 4294967296.0).cast("bigint").cast("decimal(10,0)")
    return (high.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") + low).cast("decimal(38,0)")


def int_from(entries: Column, labels: tuple[str, ...], *texts: Column) -> Column:
    """Exact where a key holds the number; through a double where a label in running text does."""
    direct = number_in(pick_first(entries, *labels)).cast("decimal(38,0)")
    searched = [exact_integer(search_number(t, k).cast("double")) for t in texts for k in labels]
    return F.coalesce(direct, *searched)


def float_from(entries: Column, labels: tuple[str, ...], *texts: Column) -> Column:
    direct = number_in(pick_first(entries, *labels), FLOAT).cast("double")
    return F.coalesce(direct, *[search_number(t, k, FLOAT).cast("double") for t in texts for k in labels])


def string_from(entries: Column, labels: tuple[str, ...], *texts: Column) -> Column:
    return F.coalesce(pick_first(entries, *labels), *[search_string(t, k) for t in texts for k in labels])


def split_prompts(value: Column) -> Column:
    """Parts between line breaks and bars, without outer blanks, commas and semicolons, inner white space collapsed; empty ones dropped."""
    parts = F.split(value, rf"\n+|{WS}*\|{WS}*")
    return F.filter(F.transform(parts, lambda p: collapse(F.btrim(p, F.lit(" ,;")))), lambda p: p != "")


def clean_artist(value: Column) -> Column:
    cleaned = F.btrim(strip(value), F.lit("\"'[]{} "))
    return F.when((cleaned == "") | F.lower(cleaned).isin(*NO_ARTIST), F.lit(None)).otherwise(collapse(cleaned))


def word_tokens(text: Column) -> Column:
    """All [a-z0-9_]+ runs of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def tokens(text: Column, stopwords: tuple[str, ...] = FAMILY_STOPWORDS, least: int = 3) -> Column:
    """Distinct tokens of `least` characters or more that are no stopwords, in order of appearance."""
    return F.array_distinct(F.filter(word_tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(*stopwords)))


def style_signature(prompt: Column, artist: Column) -> Column:
    kept = F.filter(word_tokens(prompt), lambda t: (F.length(t) > 2) & ~t.isin(*SIGNATURE_STOPWORDS))
    return F.when(artist.isNotNull(), F.concat(F.lit("artist:"), F.lower(artist))).otherwise(blank_to_null(F.array_join(kept, " ")))


def slugify(value: Column) -> Column:
    return F.coalesce(blank_to_null(F.btrim(F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]+", "_"), F.lit("_"))), F.lit("unknown"))


def label_token(value: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" ._"))
    return F.coalesce(blank_to_null(F.regexp_replace(cleaned, f"{WS}+", "_")), F.lit("Unknown"))


def sanitize_segment(value: Column) -> Column:
    return F.coalesce(blank_to_null(F.btrim(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" ."))), F.lit("Unknown"))


def prompt_family(prompt: Column) -> Column:
    """First eight hex digits of the SHA-1 of the canonical prompt; null without one."""
    return F.when(blank_to_null(prompt).isNotNull(), F.substring(F.sha1(collapse(F.lower(strip(prompt))).cast("binary")), 1, 8))


def model_series(model: Column) -> Column:
    """Model name without its version: separators to hyphens, a trailing number dropped."""
    dashed = F.regexp_replace(F.lower(model), r"(?U)[\W_]+", "-")
    return blank_to_null(F.btrim(F.regexp_replace(dashed, r"-v?\d+(\.\d+)*$", ""), F.lit("-")))


def hash_unit(text: Column, salt: str) -> Column:
    """First four bytes of SHA-1(salt:text) as a share of 2^32 - 1, six digits."""
    digest = F.substring(F.sha1(F.concat(F.lit(f"{salt}:"), F.coalesce(text, F.lit(""))).cast("binary")), 1, 8)
    return F.bround(F.conv(digest, 16, 10).cast("bigint") / F.lit(4294967295.0), 6)
