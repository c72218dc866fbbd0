"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct five-word shingles (words without case of A-Z; of fewer words, the whole sequence is one shingle).
Documents are linked where 100 * |intersection| >= 75 * |union|, and the components of the links are the classes.

1. Equal sets are one node, named by its smallest id, so copies are never paired with one another.
2. Signatures of `ROWS` * `BANDS` minima are banded. In every bucket all members are paired with the smallest one only (a star).
3. Pairs are verified in sequence: signatures are compared `STEP` minima at a time, and a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold is below `MISS`; survivors are confirmed on full sets.
4. Components of the confirmed links. Only members of a bucket that are in different components can still matter. Pairing a bucket's
   members would grow with the square of its size, so these documents meet on shingles instead: two sets of m and n elements that reach
   the threshold have o = ceil(0.75 (m + n) / 1.75) in common, so in any common order they share one of the first m - o + 1 and
   n - o + 1 elements (prefix filter), and in an order by rising counts those are seldom shared by others. The pairs found, of different components, are verified in the same way. Every
   pair that shares a bucket is thus either verified, impossible, or already in one class, whatever the bucket's size: no cap, no cut.

A pair at the threshold shares no bucket with probability (1 - 0.75^4)^32 < 6e-6.

Shingles are 64-bit hashes; sets of documents are recomputed only for documents of surviving pairs, found by a filter of fixed size.
Null, empty and blank texts have no shingles and no links. Rows with the same id are one document. A null id has its counts, no
component, and is kept. Columns other than the id and the text are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import components

from .common import Scratch, WordHashes, mix, text_bytes

WORDS = 5
ROWS, BANDS = 4, 32
MINIMA = ROWS * BANDS
STEP = 16
MISS = 1e-7
#: Bits of the filter of ids whose sets are wanted: 1 MiB whatever the input.
FILTER = 1 << 23
#: Counters of shingles that order them for the prefix filter; any order is exact, a better one pairs less.
COUNTERS = 1 << 16


@dataclass(frozen=True)
class Threshold:
    """Linked where `over` * intersection >= `part` * union."""

    part: int = 75
    over: int = 100

    @property
    def share(self) -> float:
        return self.part / self.over

    def least_matches(self) -> np.ndarray:
        """Fewest equal minima after each STEP at which P(similarity >= share) is at least MISS (uniform prior)."""
        out = []
        for k in range(STEP, MINIMA + 1, STEP):
            p, m = 0.0, -1
            while p < MISS:
                m += 1
                p += math.comb(k + 1, m) * self.share**m * (1 - self.share) ** (k + 1 - m)
            out.append(m)
        return np.array(out)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, MINIMA, np.uint64)


_WORDS: list[WordHashes] = []


def word_hashes() -> WordHashes:
    if not _WORDS:
        _WORDS.append(WordHashes())
    return _WORDS[0]


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = word_hashes().array(text.lower().split())
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - n + 1 + j])
    return np.unique(h)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MINIMA minima (32 bits) of a set, a slice of it at a time."""
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, ((s[i : i + 2048, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest of the set (null without shingles), signature."""
    a, b = _constants()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, signatures = [], [], []
            for text in text_bytes(batch.column(1)):
                s = shingles(text)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s, a, b).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n", "digest", "sig"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "id bigint, n bigint, digest binary, sig binary")


def band_rows(nodes: DataFrame) -> DataFrame:
    """key, id: one row per node and band, with a hash of the band's minima as key."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    return nodes.select("id", F.explode(keys).alias("key"))


def sizes_allow(a: Column, b: Column, t: Threshold) -> Column:
    return t.over * F.least(a, b) >= t.part * F.greatest(a, b)


def by_signature(pairs: DataFrame, nodes: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) whose signatures leave the threshold possible, compared STEP minima at a time."""
    least = t.least_matches()
    one = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    rows = pairs.join(two, "b").join(one, "a").where(sizes_allow(F.col("na"), F.col("nb"), t)).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, MINIMA) for c in (batch.column(2), batch.column(3)))
            live, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, m in enumerate(least):
                matches[live] += (x[live, i * STEP : (i + 1) * STEP] == y[live, i * STEP : (i + 1) * STEP]).sum(1)
                live = live[matches[live] >= m]
            keep = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, set (bytes) for the wanted ids and a few others: ids pass a filter of FILTER bits, built without collecting them."""
    spot = F.pmod(F.xxhash64(F.col("id")), F.lit(FILTER))
    words = wanted.select(spot.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("v"))
    told = words.toArrow()
    bits = np.zeros(FILTER // 32, np.uint32)
    bits[told.column("w").to_numpy()] = told.column("v").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            spots = batch.column(2).to_numpy()
            hit = pa.array(np.flatnonzero((bits[spots >> 5] >> (spots & 31).astype(np.uint32)) & 1))
            texts = text_bytes(batch.column(1).take(hit))
            ids = batch.column(0).take(hit)
            for i in range(0, len(texts), 500):
                yield pa.RecordBatch.from_arrays([ids.slice(i, 500), pa.array([shingles(x).tobytes() for x in texts[i : i + 500]], pa.binary())], ["id", "set"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).withColumn("spot", spot)
    return rows.mapInArrow(run, "id bigint, set binary")


def by_sets(pairs: DataFrame, docs: DataFrame, t: Threshold, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that are linked, on full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = scratch.table(sets_of(docs, wanted, id_col, text_col), "sets")
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if t.over * both >= t.part * (len(x) + len(y) - both):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    links = scratch.table(rows.mapInArrow(run, "a bigint, b bigint").distinct(), "links")
    scratch.drop(sets)
    return links


def by_prefix(docs: DataFrame, named: DataFrame, t: Threshold, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """a, b: pairs of documents of `named` (id, root) that can be linked and have different roots."""
    sets = scratch.table(sets_of(docs, named, id_col, text_col), "sets")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen += np.bincount((np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    told = sets.select("set").mapInArrow(tally, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(COUNTERS, np.int64)
    order[told.column("slot").to_numpy()] = told.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.frombuffer(x.as_buffer(), "<u8")
                take = len(s) + (-t.part * len(s)) // t.over + 1  # n - ceil(share * n) + 1, in whole numbers
                first = s[np.lexsort((s, order[(s >> np.uint64(48)).astype(np.int64)]))[:take]]
                for i in range(0, len(first), 50_000):
                    m = len(first[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, doc)), pa.array(np.full(m, len(s))), pa.array(first[i : i + m].view(np.int64)), pa.array(np.arange(i, i + m))], ["id", "n", "shingle", "place"])

    # Sets come with a few that passed the filter by chance; the join with the names drops them.
    rows = sets.mapInArrow(prefix, "id bigint, n bigint, shingle bigint, place bigint").join(named, "id")
    rows = scratch.table(rows, "prefix")
    again = scratch.table(rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle"), "again")
    rows = scratch.table(rows.join(again, "shingle"), "met")
    x, y = (rows.select("shingle", *[F.col(c).alias(c + s) for c in ("id", "root", "n", "place")]) for s in "xy")
    common = F.ceil(F.expr(f"{t.part}L * (nx + ny)") / (t.part + t.over))
    near = (F.col("placex") <= F.col("nx") - common) & (F.col("placey") <= F.col("ny") - common)
    apart = x.join(y, "shingle").where((F.col("idx") < F.col("idy")) & (F.col("rootx") != F.col("rooty")) & sizes_allow(F.col("nx"), F.col("ny"), t) & near)
    return scratch.table(apart.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct(), "apart")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, t: Threshold, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    survivors = scratch.table(by_signature(pairs, nodes, t), "survivors")
    links = by_sets(survivors, docs, t, scratch, id_col, text_col)
    scratch.drop(survivors)
    return links


def classes(spark: SparkSession, docs: DataFrame, t: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), kept (id is component_id), one row per row of `docs`."""
    scratch = Scratch(spark, "neardup")
    told = scratch.table(describe(docs, id_col, text_col), "described")
    # Equal sets: the smallest id stands for all. The pre-aggregated table is small where copies are many.
    names = scratch.table(told.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id")), "names")
    nodes = told.join(names, ["digest", "id"]).select("id", "n", "sig").dropDuplicates(["id"])
    nodes = scratch.table(nodes, "nodes")

    buckets = band_rows(nodes).groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "lead")
    buckets = scratch.table(buckets, "buckets")
    members = scratch.table(band_rows(nodes).join(buckets, "key").where("id <> lead"), "members")
    star = members.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = verify(star, nodes, docs, t, scratch, id_col, text_col)
    roots = components(links, scratch)

    # What the stars left apart: members of a bucket in different components. A bucket's lead has met all of its members.
    named = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).select("key", "id", "root")
    named = scratch.table(named, "named")
    mixed = scratch.table(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
    rest = scratch.table(named.join(mixed, "key").select("id", "root").distinct(), "rest")
    apart = by_prefix(docs, rest, t, scratch, id_col, text_col)
    if apart.limit(1).count():
        more = verify(apart, nodes, docs, t, scratch, id_col, text_col)
        roots = components(links.unionByName(more), scratch)

    # From sets to classes, then to documents: one join on the digest, with a written table on either side.
    named = names.join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    named = scratch.table(named, "classes")
    out = told.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, sh from (
  select doc_id, array_to_string(w[i:i+4], ' ') sh from (select doc_id, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4)),
n as (select doc_id, count(*) n from s group by doc_id),
f as (select sh, count(*) df from s group by sh),
r as (select s.doc_id, sh, n, row_number() over (partition by s.doc_id order by df, sh) rn from s join f using (sh) join n using (doc_id)),
p as (select * from r where rn <= n - ceil(0.75 * n - 1e-9) + 1),
c as (select distinct a.doc_id a, b.doc_id b, a.n na, b.n nb from p a join p b on a.sh = b.sh and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
e as (select a, b from (select c.a, c.b, na, nb, count(*) i from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and y.sh = x.sh group by all) where 100 * i >= 75 * (na + nb - i)),
g as (select a x, b y from e union select b, a from e),
t(x, y) as (select x, y from g union select t.x, g.y from t join g on t.y = g.x),
k as (select x doc_id, least(x, min(y)) component_id from t group by x)
select w.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(component_id, w.doc_id) component_id, w.doc_id = coalesce(component_id, w.doc_id) kept
from w left join n using (doc_id) left join k using (doc_id)
"""
