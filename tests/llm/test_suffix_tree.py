"""The suffix tree against a brute-force version in plain dictionaries, and its defined cases."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_tree as T
from tessera.llm.common import remainder

from .test_edges import ROWS, by_id, none, odd  # noqa: F401


def brute(texts: dict, held: set, depth: int = T.DEPTH, least: int = T.LEAST) -> dict[int, float]:
    """log10 probability of each text, from counts of whole sequences."""
    words = {i: [*(t or "").encode().lower().split(), b" "] for i, t in texts.items()}
    runs = [w for i, w in words.items() if i not in held]
    single = Counter(x for w in runs for x in w)
    n = sum(single.values())
    unseen = (sum(c == 1 for c in single.values()) + 1) / (n + 2) if single else 1.0
    pairs, total = [defaultdict(Counter) for _ in range(depth + 1)], [Counter() for _ in range(depth + 1)]
    for w in runs:
        for j, x in enumerate(w):
            for d in range(1, min(depth, j) + 1):
                pairs[d][tuple(w[j - d : j])][x] += 1
                total[d][tuple(w[j - d : j])] += 1

    def p(s: tuple, x: bytes) -> float:
        if not s:
            return (1 - unseen) * single[x] / n if single[x] else unseen
        kept = {y: c for y, c in pairs[len(s)][s].items() if c >= least}
        if not kept:
            return p(s[1:], x)
        t = total[len(s)][s]
        return max(kept.get(x, 0) - T.DISCOUNT, 0) / t + (1 - sum(c - T.DISCOUNT for c in kept.values()) / t) * p(s[1:], x)

    states = {}

    def is_state(s: tuple) -> bool:
        if s not in states:
            kept = {y: c for y, c in pairs[len(s)][s].items() if c >= least}
            t, above = total[len(s)][s], {y: p(s[1:], y) for y in kept}
            share = sum(kept.values()) / t if t else 0
            kl = sum(c / t * math.log(c / t / above[y]) for y, c in kept.items())
            if kept and share < 1 - 1e-12:
                kl += (1 - share) * math.log((1 - share) / max(1 - sum(above.values()), 1e-12))
            states[s] = bool(kept) and kl >= T.DIVERGENCE
        return states[s]

    out = {}
    for i, w in words.items():
        out[i] = 0.0
        for j, x in enumerate(w):
            d = next((d for d in range(min(depth, j), 0, -1) if is_state(tuple(w[j - d : j]))), 0)
            out[i] += math.log10(p(tuple(w[j - d : j]), x))
    return out


def made(seed: int, n: int = 80) -> dict[int, str]:
    rng = random.Random(seed)
    return {i: " ".join(rng.choice(["a b c d", "a c b", "x y", "c a b d", f"n{i}", "the"]) for _ in range(rng.randrange(40))) for i in range(n)}


@pytest.mark.parametrize(("block", "hot"), [(T.BLOCK, T.HOT), (700, T.HOT), (700, 40), (T.BLOCK, 2)])
def test_brute_force(spark, block, hot):
    """Whatever the blocks, and with hot contexts dealt by event."""
    texts = made(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = by_id(T.score(spark, df, F.col("doc_id") % 5 == 0, block=block, hot=hot))
    want = brute(texts, {i for i in texts if i % 5 == 0})
    for i in texts:
        assert got[i]["score"] == pytest.approx(want[i], rel=1e-9, abs=1e-9), i


def test_whole_table(spark, sf_dir):
    """The query's scores on the smallest tables."""
    import zlib

    from tessera.llm import queries as Q

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = brute(texts, {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2})
    got = by_id(Q.op1_suffix_tree(spark, sf_dir))
    # A told probability is rounded, so a context whose divergence is at the threshold may be judged otherwise.
    off = [i for i in texts if abs(got[i]["score"] - want[i]) > 1e-6 * abs(want[i])]
    assert len(off) <= 0.02 * len(texts), off


def test_probes(spark):
    """Every symbol, known or not, after every kind of beginning."""
    texts = made(1)
    begin = ["", "a", "a b", "x y c", "the the the"]
    words = ["a", "b", "c", "d", "x", "y", "the", "unseen", "n3", ""]
    ask = {1000 + 1000 * k + m: f"{b} {w}".strip() for k, b in enumerate(begin) for m, w in enumerate(words)}
    df = spark.createDataFrame([*texts.items(), *ask.items()], "doc_id bigint, text string")
    got, want = by_id(T.score(spark, df, F.col("doc_id") >= 1000)), brute(texts | ask, set(ask))
    assert all(got[i]["score"] == pytest.approx(want[i], abs=1e-9) for i in ask)


def test_grows_with_the_corpus(spark):
    """What occurs three times is learnt, however large the rest of the corpus is: 400,000 other words here, of which it is no share of 1e-5."""
    rng = random.Random(6)
    texts = [" ".join(f"f{rng.randrange(8)}" for _ in range(4000)) for _ in range(100)] + ["blue moon rises slowly"] * 3
    got = by_id(T.score(spark, spark.createDataFrame([*enumerate(texts), (1000, "blue moon rises slowly"), (1001, "slowly rises moon blue")], "doc_id bigint, text string"), F.col("doc_id") >= 1000))
    assert got[1000]["score"] > got[1001]["score"] + 8


def test_edges(spark, odd, none):  # noqa: F811
    got = T.score(spark, odd, remainder(F.col("doc_id"), 7) == 2)
    rows = by_id(got)
    assert got.count() == len(ROWS) and rows[2]["n_tokens"] == 1 and rows[5]["n_tokens"] == 30_001
    assert T.score(spark, none, F.lit(False)).count() == 0
    unseen = T.score(spark, odd, F.lit(True)).collect()
    assert {r["train_tokens"] for r in unseen} == {0} and all(abs(r["score"]) < 1e-9 and r["base_score"] == 0 for r in unseen)


def test_packing_of_numbers():
    import numpy as np

    for x in ([], [0], [255, 256, 2**63 + 5], list(range(1000))):
        a, b = T.unpack(T.pack(np.array(x, np.uint64), np.array([7], np.uint64)))
        assert a.tolist() == x and b.tolist() == [7]
