"""Connected components of an edge table, by contraction.

Each round hooks every node to its smallest neighbour (or itself), flattens the resulting trees by pointer jumping, and contracts the
edges to the roots. Every component that still has an edge loses at least half of its roots in a round, so the number of rounds
is logarithmic in the longest chain. Minima are pre-aggregated, joins read written tables on either side (so that a hot root can be split
by skew handling), and nothing but two counts a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge. Loops and repeated edges count once; null ends are no edge."""
    left, right = F.col(a), F.col(b)
    edges = scratch.table(edges.where(left.isNotNull() & right.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    roots = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = scratch.table(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")), "up")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            further = scratch.table(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jump")
            scratch.drop(up)
            moved, up = further.where("moved").limit(1).count(), further.drop("moved")
            if not moved:
                break
        if roots is None:
            roots = up
        else:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = scratch.table(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        contracted = scratch.table(ends.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        scratch.drop(edges)
        edges = contracted
        if not edges.limit(1).count():
            return roots
