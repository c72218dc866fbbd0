"""Groups inside buckets: exact duplicates, near duplicates, prompt families, model series, visually similar rows, and the rest.

Two forms with the same members:

* `cascade`: set-wise passes of joins and connected components. Nothing of a bucket's size is held by one task. Clusters are
  numbered by their smallest id.
* `cascade_by_bucket`: the pairwise procedure on one bucket per task, where a cluster's number follows from the order in which
  pairs are united. For buckets of bounded size that need this numbering.

Input columns: image_id, path (array of labels: the bucket), checksum, perceptual_hash, difference_hash (hex), embedding, tokens (of
the prompt), series, n_issues, width, height, size, file_name.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.scratch import Scratch

from .components import components
from .pairs import cosine_pairs, equal_hashes, equal_sets, hamming_pairs, jaccard_pairs, set_digest
from .ranking import best_of, representative_order, running


@dataclass(frozen=True)
class Thresholds:
    near: float = 8.0
    family: float = 0.58
    visual: float = 0.92


PASSES = ("exact_duplicate", "near_duplicate", "same_prompt_family", "same_model_series", "visual_similar", "unique")
#: Half of the last digit of a similarity that is rounded to four before it is compared.
ROUNDING = 0.00005


def order_of(df: DataFrame) -> list[Column]:
    return representative_order(F.col("n_issues"), F.col("width"), F.col("height"), F.col("size"), F.col("file_name"), F.col("image_id"))


def _clusters(rest: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """image_id, cluster of the rows that a pair links."""
    return components(pairs, scratch).select(F.col("node").alias("image_id"), F.col("root").alias("cluster"))


def _spread(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of representatives and, for equal rows, the star from each representative to its copies."""
    return pairs.select("a", "b").unionByName(members.where("rep <> image_id").select(F.col("rep").alias("a"), F.col("image_id").alias("b")))


def _near(rest: DataFrame, t: Thresholds, scratch: Scratch) -> DataFrame:
    p, d = S.hash_bits(F.col("perceptual_hash")), S.hash_bits(F.col("difference_hash"))
    pairs = hamming_pairs(rest, "image_id", F.col("path"), p, d, t.near)
    return _clusters(rest, pairs.select("a", "b").unionByName(equal_hashes(rest, "image_id", F.col("path"), p, d)), scratch)


def _family(rest: DataFrame, t: Thresholds, scratch: Scratch) -> DataFrame:
    sets = scratch.table(equal_sets(rest, "image_id", F.col("path"), F.col("tokens")), "sets")
    pairs = jaccard_pairs(sets, t.family, ROUNDING, scratch)
    again = sets.where("copies > 1").select("bucket", "rep", set_digest(F.col("tokens")).alias("digest"))
    members = rest.select("image_id", F.col("path").alias("bucket"), set_digest(F.array_sort("tokens")).alias("digest")).join(again, ["bucket", "digest"]).select("image_id", "rep")
    return _clusters(rest, _spread(pairs, members), scratch)


def _series(rest: DataFrame, t: Thresholds, scratch: Scratch) -> DataFrame:
    known = rest.where("series is not null")
    first = known.groupBy("path", "series").agg(F.min("image_id").alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(first, ["path", "series"]).select("image_id", "cluster")


def _visual(rest: DataFrame, t: Thresholds, scratch: Scratch) -> DataFrame:
    """Cosine or hash similarity reaches the threshold; ids are numbered for the matrix blocks."""
    numbers = scratch.table(rest.select("image_id", "path", "embedding", "perceptual_hash", "difference_hash", F.monotonically_increasing_id().alias("k")), "numbers")
    by_vector = cosine_pairs(numbers, "k", F.concat_ws("\x1f", "path"), F.col("embedding"), t.visual - ROUNDING).where(F.bround("cosine", 4) >= t.visual)
    by_vector = by_vector.join(numbers.select(F.col("k").alias("a"), F.col("image_id").alias("x")), "a").join(numbers.select(F.col("k").alias("b"), F.col("image_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    by_hash = hamming_pairs(rest, "image_id", F.col("path"), S.hash_bits(F.col("perceptual_hash")), S.hash_bits(F.col("difference_hash")), 64 * (1 - t.visual + ROUNDING))
    by_hash = by_hash.where(S.hash_similarity(F.col("distance")) >= t.visual).select("a", "b")
    return _clusters(rest, by_vector.unionByName(by_hash), scratch)


def _exact(rest: DataFrame, t: Thresholds, scratch: Scratch) -> DataFrame:
    """Numbered by the first member in representative order, so the cluster key is that member's place."""
    known = rest.where("checksum is not null")
    again = known.groupBy("path", "checksum").agg(F.count(F.lit(1)).alias("n"), F.min(best_of(*map(F.col, ("n_issues", "width", "height", "size", "file_name", "image_id"))))["id"].alias("cluster")).where("n > 1")
    return known.join(again.select("path", "checksum", "cluster"), ["path", "checksum"]).select("image_id", "cluster")


def cascade(rows: DataFrame, t: Thresholds, scratch: Scratch) -> DataFrame:
    """image_id, path, group_type, cluster: each pass takes what the ones before it left."""
    rest = scratch.table(rows, "rows")
    done = []
    for kind, step in zip(PASSES, (_exact, _near, _family, _series, _visual)):
        found = scratch.table(step(rest, t, scratch), kind)
        done.append(found.select("image_id", "cluster", F.lit(kind).alias("group_type")))
        left = scratch.table(rest.join(found, "image_id", "left_anti"), "rest")
        scratch.drop(rest)
        rest = left
    done.append(rest.select("image_id", F.lit(None).cast("string").alias("cluster"), F.lit("unique").alias("group_type")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return scratch.table(rows.join(out, "image_id").select(*rows.columns, "cluster", "group_type"), "clustered")


def numbered(clustered: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per group: path, group_type, cluster, index, group_id, representative, members. Indexes run over buckets in path order; `unique` takes one too.

    Groups per bucket are counted first, so that the running offset is over buckets, not rows, and runs in ranges of paths.
    """
    best = best_of(*map(F.col, ("n_issues", "width", "height", "size", "file_name", "image_id")))
    groups = clustered.groupBy("path", "group_type", "cluster").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("members"))
    rank = F.array_position(F.array(*map(F.lit, PASSES)), F.col("group_type"))
    inside = F.when(F.col("group_type") == "exact_duplicate", F.col("best")).otherwise(F.lit(None))
    w = Window.partitionBy("path").orderBy(rank, inside.asc_nulls_first(), "cluster")
    groups = groups.withColumn("place", F.row_number().over(w))
    before = running(groups.groupBy("path").agg(F.count(F.lit(1)).alias("n")), ["path"], F.col("n"), scratch).drop("n")
    index = F.col("before") + F.col("place")
    label = F.when(F.col("group_type") == "unique", "unique").otherwise(F.format_string("%s_%03d", "group_type", index))
    return groups.join(before, "path").select("path", "group_type", "cluster", index.alias("index"), label.alias("group_id"), F.col("best.id").alias("representative"), "members")


def relation_score(kind: Column, left: str, right: str) -> Column:
    """Score of a member (`right`.*) against its representative (`left`.*)."""
    l, r = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))  # noqa: E741
    bits = [S.hash_bits(f(c)) for f in (l, r) for c in ("perceptual_hash", "difference_hash")]
    hashed = S.hash_similarity(S.combined_distance(*bits))
    visual = F.bround(F.greatest(S.cosine(l("embedding"), r("embedding")), hashed), 4)
    series = F.when(l("series") == r("series"), 1.0)
    return (
        F.when(kind == "exact_duplicate", 1.0).when(kind == "near_duplicate", hashed).when(kind == "same_prompt_family", F.bround(S.jaccard(l("tokens"), r("tokens")), 4))
        .when(kind == "same_model_series", series).when(kind == "visual_similar", visual)
    )


def members(clustered: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row with its group, score and whether it is the representative."""
    keys = ["path", "group_type", "cluster"]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    g = groups.select(*keys, "group_id", "index", "representative").alias("y")
    rows = clustered.alias("x").join(g, same).select("x.*", "group_id", "index", "representative")
    features = ["perceptual_hash", "difference_hash", "embedding", "tokens", "series"]
    best = clustered.select(F.col("image_id").alias("representative"), F.struct(*features).alias("rep"))
    rows = rows.join(best, "representative", "left").withColumn("own", F.struct(*features))
    return rows.select("path", "group_id", "group_type", "index", "image_id", relation_score(F.col("group_type"), "rep", "own").alias("relation_score"), (F.col("image_id") == F.col("representative")).alias("is_representative"), "representative")


# --- one bucket per task ------------------------------------------------------------------------------------------------------
def _unite(n: int, pairs, ids: list[str]) -> list[list[int]]:
    """Clusters of 0..n-1 in order of their root's id; the left root stays root, pairs come in order of the rows."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in pairs:
        i, j = top(i), top(j)
        if i != j:
            root[j] = i
    out = defaultdict(list)
    for i in range(n):
        out[top(i)].append(i)
    return [out[r] for r in sorted(out, key=lambda r: ids[r])]


def _pairs_of(kind: str, b: pd.DataFrame, t: Thresholds):
    """Index pairs that a pass links, row by row, each row compared with all later ones at once."""
    n = len(b)
    if kind == "near_duplicate" or kind == "visual_similar":
        num = lambda c: [int(x, 16) if isinstance(x, str) and x else None for x in b[c]]
        p, d, v = num("perceptual_hash"), num("difference_hash"), list(b["embedding"])
    for i in range(n):
        for j in range(i + 1, n):
            if kind == "same_prompt_family":
                x, y = set(b["tokens"].iloc[i]), set(b["tokens"].iloc[j])
                hit = bool(x and y) and round(len(x & y) / len(x | y), 4) >= t.family
            elif kind == "same_model_series":
                hit = isinstance(b["series"].iloc[i], str) and b["series"].iloc[i] == b["series"].iloc[j]
            else:
                away = lambda h: 64 if h[i] is None or h[j] is None else (h[i] ^ h[j]).bit_count()  # noqa: E731, B023
                distance = (away(p) + away(d)) / 2
                if kind == "near_duplicate":
                    hit = (v[i] is not None and v[j] is not None) and distance <= t.near
                else:
                    x, y = (np.asarray([] if q is None else q, float) for q in (v[i], v[j]))
                    norm = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()) if len(x) == len(y) else 0
                    close = float(x @ y / norm) if norm else 0.0
                    hit = (v[i] is not None and v[j] is not None) and round(max(close, round(max(0.0, 1 - distance / 64), 4)), 4) >= t.visual
            if hit:
                yield i, j


def cascade_by_bucket(rows: DataFrame, t: Thresholds) -> DataFrame:
    """path, image_id, group_type, place (of the group inside its bucket), by the pairwise procedure."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        area = b["width"].fillna(0).astype("int64") * b["height"].fillna(0).astype("int64")
        b = b.assign(_a=-area, _s=-b["size"], _f=b["file_name"].str.lower()).sort_values(["n_issues", "_a", "_s", "_f", "image_id"], kind="stable").reset_index(drop=True)
        out, place = [], 0

        def put(members: pd.DataFrame, kind: str) -> None:
            nonlocal place
            place += 1
            out.extend((i, kind, place) for i in members["image_id"])

        for kind in PASSES[:-1]:
            if kind == "exact_duplicate":
                known = b[b["checksum"].notna()]
                clusters = [list(g) for g in known.groupby("checksum", sort=False).groups.values()]
            else:
                clusters = _unite(len(b), _pairs_of(kind, b, t), list(b["image_id"]))
            clusters = [c for c in clusters if len(c) > 1]
            for c in clusters:
                put(b.loc[c], kind)
            b = b.drop(index=[i for c in clusters for i in c]).reset_index(drop=True)
        if len(b):
            put(b, "unique")
        result = pd.DataFrame(out, columns=["image_id", "group_type", "place"])
        return result

    return rows.groupBy("path").applyInPandas(run, "image_id string, group_type string, place int")
