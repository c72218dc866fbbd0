"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The distinct shingles of a text (five words, without case of A-Z; a text of fewer words is one shingle) are hashed once. The hash's
high bits choose one of `BINS` bins, the least hash in a bin is the bin's value. Empty bins are filled by optimal densification: each
takes the value of the non-empty bin that comes first in the empty bin's own pseudo-random order of bins, the same order for every
text. The fingerprint is the low `BITS` bits of every bin, as hexadecimal. Likeness is the share of equal bins, corrected for chance
equality of the low bits: (p - c) / (1 - c) with c = 2^-BITS, and not below 0.

Null, empty and blank texts have the empty fingerprint; two of them are alike (1.0), and unlike any other (0.0). Equal texts have equal
fingerprints. Whole texts are used, whatever their length; columns other than the id and the text are never read.

`with_next` gives every document its successor by ascending id (the last one gets the first) without a global sort: ids are cut
into ranges at their quantiles, a document that begins a range is also dealt to the range before, and a window inside each range
does the rest. Equal ids are ordered by text; null ids come first. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, words

BINS = 256
BITS = 8
SHINGLE = 5
GAP = -9999
#: Probes of an empty bin before its donor is found by rank.
PROBES = 8
#: Documents in a range of ids, and ranges at most (their bounds are literals of the plan).
RANGE = 500
RANGES = 32_768


def hashes(w: Column, k: int = SHINGLE) -> Column:
    """array<bigint>: the sorted hashes of a word array's shingles, shifted to be non-negative (62 bits); repeats are left in."""
    shingle = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), 2)
    whole = F.array(F.shiftrightunsigned(F.xxhash64(w), 2))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, whole).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - k), shingle))


def add_fingerprint(df: DataFrame, text: str, out: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """`df` with the bins of column `text` in column `out`: array<tinyint> of low bits less 2^(bits-1); empty without words.

    Each step is a projection of its own, so nothing is computed twice.
    """
    shift, mask, half = 62 - int(math.log2(bins)), (1 << bits) - 1, 1 << bits >> 1
    keep = df.columns
    place = lambda h: F.shiftright(h, shift).cast("int")
    low = lambda h: (h.bitwiseAND(F.lit(mask)) - half).cast("int")
    df = df.withColumn("_w", words(ascii_lower(F.col(text))))
    df = df.select(*keep, F.sort_array(hashes(F.col("_w"))).alias("_h"))
    least = F.filter(F.col("_h"), lambda h, i: (i == 0) | (place(h) != place(F.get(F.col("_h"), i - 1))))
    df = df.select(*keep, least.alias("_m"))
    # Sorted minima to one slot per bin: each with as many gaps behind it as bins are empty.
    after = lambda i: F.coalesce(place(F.get(F.col("_m"), i + 1)), F.lit(bins))
    slots = F.flatten(F.transform("_m", lambda h, i: F.concat(F.array(low(h)), F.array_repeat(F.lit(GAP), after(i) - place(h) - 1))))
    df = df.select(*keep, "_m", F.concat(F.array_repeat(F.lit(GAP), place(F.get(F.col("_m"), F.lit(0)))), slots).alias("_s"))

    def donor(i: Column) -> Column:
        """What the first non-empty bin in bin i's order holds: probes, then, if all fail, the bin with the least rank."""
        probe = lambda t: F.get(F.col("_s"), F.pmod(F.xxhash64(i, t), F.lit(bins)).cast("int"))
        tried = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), F.lit(GAP), lambda a, t: F.when(a != GAP, a).otherwise(probe(t)))
        ranks = F.transform("_m", lambda h: F.struct(F.xxhash64(i, place(h)).alias("r"), low(h).alias("v")))
        return F.when(tried != GAP, tried).otherwise(F.array_min(ranks)["v"])

    filled = F.transform("_s", lambda v, i: F.when(v != GAP, v).otherwise(F.coalesce(donor(i), F.lit(0))).cast("tinyint"))
    return df.select(*keep, F.when(F.size("_m") == 0, F.array().cast("array<tinyint>")).otherwise(filled).alias(out))


def as_text(bins: Column, bits: int = BITS) -> Column:
    """A fingerprint's bins packed as hexadecimal, bits / 4 digits a bin."""
    digits = F.split(F.lit(" ".join(f"{v:0{bits // 4}x}" for v in range(1 << bits))), " ")
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v.cast("int") + (1 << bits >> 1))), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Bias-corrected share of equal bins of two fingerprints."""
    chance = 2.0**-bits
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    share = (equal / F.greatest(F.size(a), F.lit(1)) - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), share))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts that are <= key, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit("[" + ",".join(map(str, cuts)) + "]"), "array<bigint>")
    steps = math.ceil(math.log2(len(cuts) + 1)) + 1
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(table, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", order: str = "text") -> DataFrame:
    """`docs` (id, `order` and `columns`) with `next_<column>` of the successor by id."""
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))
    ids = docs.select(key.alias("k"))
    n = ids.count()
    if n == 0:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    parts = min(RANGES, max(1, n // RANGE))
    cuts = sorted({int(c) for c in ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).head()[0]}) if parts > 1 else []
    firsts = {r["r"]: r["k"] for r in ids.groupBy(_range_of(F.col("k"), cuts).alias("r")).agg(F.min("k").alias("k")).collect()}
    used = sorted(firsts)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    # By range: the id that begins it, and the range before it. A first document also goes there, behind all of that range's own rows.
    first_of, before_of = (F.from_json(F.lit(json.dumps([d.get(r) for r in range(len(cuts) + 1)])), "array<bigint>") for d in (firsts, before))
    rows = docs.withColumn("_k", key).withColumn("_r", _range_of(F.col("_k"), cuts).cast("bigint"))
    own = F.struct(F.col("_r").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(before_of, F.col("_r").cast("int")).alias("r"), F.lit(True).alias("guest"))
    rows = rows.withColumn("_p", F.explode(F.when(F.get(first_of, F.col("_r").cast("int")) == F.col("_k"), F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("*", F.col("_p.r").alias("_at"), F.col("_p.guest").alias("_guest"))
    w = Window.partitionBy("_at").orderBy("_guest", "_k", order)
    rows = rows.select(*docs.columns, "_guest", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return rows.where(~F.col("_guest")).drop("_guest")


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter is replaced by the successor's beginning, and their likeness."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(add_fingerprint(rows, "text", "a"), ["text", "a"], id_col)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), "a", F.col("next_a").alias("c"), edited.alias("_edited"))
    rows = add_fingerprint(rows, "_edited", "b")
    return rows.select(
        id_col, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
