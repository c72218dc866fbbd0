"""Similarity joins, running numbers and names against brute force, on small random tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import pairs, ranking
from tessera.scratch import Scratch


@pytest.mark.parametrize("most", range(129))
def test_bands(most):
    """However `most` different bits fall, some band has no more than the radius."""
    bands, radius = pairs.bands_of(most)
    assert bands * (radius + 1) > most and 1 <= bands <= 128


@pytest.mark.parametrize("threshold", [0.42, 0.58, 1.0])
def test_jaccard(spark, threshold):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["often"] * 30
    rows = []
    for i in range(160):
        base = set(rng.choices(vocabulary, k=rng.randrange(1, 25))) if i % 3 or not rows else set(rows[-1][2]) ^ {rng.choice(vocabulary)}
        rows.append((i, rng.choice(["a", "b", None]), sorted(base)))
    sets = pairs.equal_sets(spark.createDataFrame(rows, "id bigint, b string, t array<string>"), "id", F.col("b"), F.col("t"))
    got = {(r["a"], r["b"]): r["overlap"] for r in pairs.jaccard_pairs(sets, threshold).collect()}
    first = {}
    for i, b, t in rows:
        if t:
            first.setdefault((b, tuple(t)), i)
    want = {}
    for (b, t), i in first.items():
        for (c, u), j in first.items():
            if b == c and i < j and len(set(t) & set(u)) / len(set(t) | set(u)) >= threshold:
                want[i, j] = len(set(t) & set(u))
    assert got == want and (want or threshold == 1.0)


@pytest.mark.parametrize("threshold", [0.0, 3.0, 8.0, 17.5])
def test_hamming(spark, threshold):
    rng = random.Random(5)
    word = lambda: rng.getrandbits(64) - (1 << 63)
    rows = []
    for i in range(120):
        p, d = (word(), word()) if i % 4 == 0 or not rows else rows[-1][2:]
        if i % 4:
            for _ in range(rng.randrange(0, 14)):
                p ^= 1 << rng.randrange(63)
            d ^= 1 << rng.randrange(63) if rng.random() < 0.5 else 0
        rows.append((i, rng.choice(["a", None]), p, d))
    got = {(r["a"], r["b"]): r["distance"] for r in pairs.hamming_pairs(spark.createDataFrame(rows, "id bigint, b string, p bigint, d bigint"), "id", F.col("b"), F.col("p"), F.col("d"), threshold).collect()}
    first = {}
    for i, b, p, d in rows:
        first.setdefault((b, p, d), i)
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(i, j): (bits(p, q) + bits(d, e)) / 2 for (b, p, d), i in first.items() for (c, q, e), j in first.items() if b == c and i < j and (bits(p, q) + bits(d, e)) / 2 <= threshold}
    assert got == want


@pytest.mark.parametrize("threshold", [0.0, 3.0, 20.0])
def test_hamming_copies(spark, threshold):
    """With copies, each pair of rows; and the stars from the first of equal hashes."""
    rng = random.Random(6)
    word = lambda: rng.getrandbits(64) - (1 << 63)
    rows = [(f"r{i:02}", "b", word(), word()) for i in range(10)]
    rows += [(f"s{i:02}", rng.choice(["b", None]), p ^ (i % 3), d) for i in range(40) for _, _, p, d in [rng.choice(rows[:10])]]
    df = spark.createDataFrame(rows, "id string, b string, p bigint, d bigint")
    of = df, "id", F.col("b"), F.col("p"), F.col("d")
    got = [(r["a"], r["b"], r["distance"]) for r in pairs.hamming_pairs(*of, threshold, copies=True).collect()]
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = [(i, j, (bits(p, q) + bits(d, e)) / 2) for i, b, p, d in rows for j, c, q, e in rows if b == c and i < j and (bits(p, q) + bits(d, e)) / 2 <= threshold]
    assert sorted(got) == sorted(want) and any(x[2] == 0 for x in want)
    first = {}
    for i, b, p, d in rows:
        first.setdefault((b, p, d), i)
    assert {tuple(r) for r in pairs.equal_hashes(*of).collect()} == {(first[b, p, d], i) for i, b, p, d in rows if first[b, p, d] != i}


def test_jaccard_blocks(spark, monkeypatch):
    """Many small blocks, sets from one token to thousands; no pair is lost or met twice."""
    monkeypatch.setattr(pairs, "CELLS", 1 << 14)
    rng = random.Random(8)
    rows = []
    for i in range(150):
        base = {f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 5, 40, 300, 2500]))} if i % 3 == 0 else set(rng.sample(rows[-1][2], max(1, int(len(rows[-1][2]) * 0.9)))) | {f"x{i}"}
        rows.append((i, "a", sorted(base)))
    sets = pairs.equal_sets(spark.createDataFrame(rows, "id bigint, b string, t array<string>"), "id", F.col("b"), F.col("t"))
    got = sorted((r["a"], r["b"], r["overlap"]) for r in pairs.jaccard_pairs(sets, 0.5).collect())
    s = [(i, set(t)) for i, _, t in rows]
    assert got == [(i, j, len(x & y)) for i, x in s for j, y in s if i < j and len(x & y) / len(x | y) >= 0.5] and len(got) > 50


def test_set_digest(spark):
    """Sets that read alike when joined have different digests."""
    sets = [["a", "b"], ["a,b"], ["a,1:b"], ["a", "1:b"], ["ab"], ["1:a"], ["a"], []]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in sets], "t array<string>").select(pairs.set_digest(F.col("t"))).collect()]
    assert len(set(got)) == len(sets)


def test_running(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abc"), rng.randrange(10)) for i in range(300)]
    got = {r["i"]: r["before"] for r in ranking.running(spark.createDataFrame(rows, "i bigint, k string, v bigint"), ["k", "i"], F.col("v"), Scratch(spark, "t")).collect()}
    total = 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[i] == total
        total += v
    assert ranking.running(spark.createDataFrame([], "i bigint, v bigint"), ["i"], F.col("v"), Scratch(spark, "t")).count() == 0


def test_names(spark):
    """Against counting up one row after the other, over the whole folder."""
    rng = random.Random(9)
    names = ["a.png", "a_1.png", "a_1_1.png", "b.png", "b", ".x", "c.tar.gz", "c_2.tar.gz", "d.", "e.png"]
    rows = [(i, rng.choice("fg"), rng.choice(names)) for i in range(150)]
    old = {("f", "e.png"), ("f", "e_2.png"), ("g", "b")}
    got = {r["i"]: (r["resolved"], r["met_existing"]) for r in ranking.rename_collisions(spark.createDataFrame(rows, "i bigint, d string, n string"), "d", "n", ["i"], spark.createDataFrame(list(old), "d string, n string")).collect()}
    used = set(old)
    for i, d, n in rows:
        dot, name, k = n.rfind("."), n, 0
        stem, suffix = (n[:dot], n[dot:]) if 0 < dot < len(n) - 1 else (n, "")
        while (d, name) in used:
            k += 1
            name = f"{stem}_{k}{suffix}"
        used.add((d, name))
        assert got[i] == (name, (d, n) in old), (i, d, n)
