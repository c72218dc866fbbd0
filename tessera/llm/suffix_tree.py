"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are a text's words (A-Z lower-cased) and one end; an unseen word is one symbol of its own, as in the add-one base. The root's
distribution is that of single symbols, with the mass that Good and Turing give to unseen ones (words seen once as a share of all).
A context s is the last one to `DEPTH` words; it and its next symbols x are kept from `LEAST` occurrences on, whatever the size of the
corpus. Distributions are smoothed towards those of the suffix s' (s without its oldest word):
P(x|s) = max(c(sx) - D, 0) / c(s) + B(s) P(x|s'), where B(s) is what the kept, discounted counts leave. A context is a state of the
tree if the divergence of its counts from P(.|s') - over its kept symbols, and all others as one - is at least `DIVERGENCE`.
A symbol's probability is that of the longest state that is a suffix of what precedes it.

Counts are of all training documents and are never gathered or broadcast. Texts are held as blocks (rows of a table bucketed by
block: word numbers of its texts, its distinct words). Level by level each block asks: for every part of the key space one packed
list of its distinct contexts and (context, symbol) events with its own counts. A part adds up what the blocks ask and answers every
block in the order of its list: counts, what is left, and whether the context is a state. So a count travels once per block and
part, not once per occurrence, and a level costs one exchange of asks and one of answers; blocks stay where they are. Only what
can matter is asked: a sequence can reach `LEAST` only if the shorter ones in it do. Contexts with a `HOT` share of all symbols
are dealt by event, so that no part holds one of them whole; their sums (at most 1 / share contexts a level) are told to all blocks.

Words, contexts and events are compared by 64-bit hashes; among n distinct ones a pair collides with probability n^2 / 2^65. (An ask
tells symbols by 48 bits of their hashes: two of one context collide with probability 2^-48.) A block
holds whole texts, so memory follows `BLOCK` or the longest text. Null, empty and blank texts have the end alone. Repeated rows count
and are scored as often as they occur; a null id counts as a training row. Columns other than the id and the text are never read; an
empty table gives an empty result, and without training rows every symbol is the unseen one, of probability 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, text_bytes

DEPTH = 3
LEAST = 2
DIVERGENCE = 0.02
DISCOUNT = 0.75
#: Stands for the end; no word holds a blank.
END = b" "
#: Bytes of text in a block, about.
BLOCK = 5 << 20
#: A context is hot from this many occurrences on, or from this share of all symbols if that is more.
HOT, HOT_SHARE = 1 << 18, 1 / (1 << 16)
#: Blocks whose asks one part of the key space gets, as a multiple of the parts; and parts at least.
BLOCKS_A_PART, PARTS = 4, 384
#: Steps of a told log2 of a probability.
GRAIN = 512
OLDER, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ANSWER = "block bigint, part int, level int, told binary, key bigint, kept bigint, mass bigint, gain double, above double"


class Numbered(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes (no more than the largest needs; hashes as they are), compressed; any number of arrays."""
    import zstandard

    out = [np.array([len(arrays), *(len(x) for x in arrays)], "<u8").tobytes()]
    for x in arrays:
        planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        x = x.astype("<u8", copy=False)
        out += [bytes([planes]), x.tobytes() if planes == 8 else np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(b: bytes | pa.BinaryScalar) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b.as_buffer() if isinstance(b, pa.BinaryScalar) else b)
    k = int(np.frombuffer(raw, "<u8", 1)[0])
    out, at = [], 8 * (k + 1)
    for n in np.frombuffer(raw, "<u8", k, 8).tolist():
        planes, at = raw[at], at + 1
        if planes == 8:
            out.append(np.frombuffer(raw, "<u8", n, at))
        else:
            x = np.zeros((n, 8), np.uint8)
            x[:, :planes] = np.frombuffer(raw, np.uint8, n * planes, at).reshape(planes, n).T
            out.append(x.view("<u8").ravel())
        at += n * planes
    return out


def rising(x: np.ndarray) -> np.ndarray:
    """Differences, modulo 2^64: small where x is sorted."""
    return np.diff(x, prepend=np.uint64(0))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of a key, by its leading bits, so that sorted keys have rising parts."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def follow(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context * NEXT + symbol)


def grouped(x: np.ndarray) -> np.ndarray:
    """An order in which equal values stand together, by rising leading bits.

    Values are sorted (several times faster than places are) with their places in the low bits. Values too large for that keep
    their leading bits; in the rare case that two of them differ below these only, places are sorted after all.
    """
    bits = max(1, (len(x) - 1).bit_length())
    place = np.arange(len(x), dtype=np.uint64)
    x = x.astype(np.uint64, copy=False)
    small = len(x) == 0 or int(x.max()) < 1 << 64 - bits
    s = x << np.uint64(bits) if small else x >> np.uint64(bits) << np.uint64(bits)
    s |= place
    s.sort()
    order = (s & np.uint64((1 << bits) - 1)).astype(np.int64)
    if not small:
        v, s = x[order], s >> np.uint64(bits)
        if ((s[1:] == s[:-1]) & (v[1:] != v[:-1])).any():
            return np.argsort(x, kind="stable")
    return order


def first_and_number(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups x, where each distinct value begins in it, and the number of every element's value."""
    order = grouped(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    s = x[order]
    np.not_equal(s[1:], s[:-1], out=new[1:])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def added(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, begin) if len(begin) else x[:0]


@dataclass(frozen=True)
class Told:
    """What all blocks know of the training texts: symbols, distinct ones, those that occur once, parts, and the sums of hot contexts by level."""

    n: int = 0
    distinct: int = 0
    once: int = 0
    parts: int = 1
    hot: int = HOT
    sums: tuple = ()

    @property
    def unseen(self) -> float:
        return (self.once + 1) / (self.n + 2) if self.distinct else 1.0


def divergence(total: np.ndarray, kept: np.ndarray, mass: np.ndarray, gain: np.ndarray, above: np.ndarray) -> np.ndarray:
    """KL of a context's counts from the shorter context's probabilities: sums over the kept symbols (their number, counts, c ln(c / P'), P'), the others as one."""
    t = total.astype(np.float64)
    left, left_above = np.maximum(1 - mass / t, 0.0), np.maximum(1 - above, 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(left > 0, left * np.log(left / left_above), 0.0)
    return np.where(kept > 0, gain / t - mass / t * np.log(t) + rest, 0.0)


class Level:
    """A block's distinct contexts and events of one depth, in the order in which they are asked: by part, context, event."""

    def __init__(self, live: np.ndarray, key: np.ndarray | None, total: np.ndarray, asked: np.ndarray, walk: Walk):
        """Places that are live, keys and totals of their contexts (None: the words before them), and which of the places ask for their event."""
        parts, hot = walk.told.parts, walk.told.hot
        self.live = live
        if key is None:
            word = walk.tokens[live - 1]
            some = np.bincount(word, minlength=len(walk.hashes)) > 0
            self.keys = walk.hashes[chosen := walk.order[some[walk.order]]]
            number = np.zeros(len(walk.hashes), np.int64)
            number[chosen] = np.arange(len(chosen))
            self.context = number[word]
            self.total = np.zeros(len(chosen), np.int64)
            self.total[self.context] = total
        else:
            order, begin, self.context = first_and_number(key)
            first = order[begin]
            self.keys, self.total = key[first], total[first]
        self.places = np.flatnonzero(asked)
        symbol = walk.tokens[live[self.places]]
        order, begin, self.event = first_and_number(self.context[self.places] * len(walk.hashes) + symbol)
        one = order[begin]
        of, symbol = self.context[self.places[one]], symbol[one]
        self.of, self.walk, self.order, self.begin = of, walk, order, begin
        self.symbols = lambda: walk.hashes[symbol] >> np.uint64(16)
        hash_events = lambda: follow(self.keys[of], self.symbols())
        # Entries: a context of its own part, or a hot context in every part that gets one of its events.
        is_hot = self.total >= hot
        entry_context, entry_part, event_entry = np.arange(len(self.keys)), part_of(self.keys, parts), of
        self.by_event = by_part = slice(None)
        if is_hot.any():
            h, events = np.flatnonzero(is_hot[of]), hash_events()
            pairs, which = np.unique(part_of(events[h], parts) * len(self.keys) + of[h], return_inverse=True)
            plain = np.flatnonzero(~is_hot)
            place = np.zeros(len(self.keys), np.int64)
            place[plain] = np.arange(len(plain))
            entry_context = np.concatenate([plain, pairs % max(1, len(self.keys))])
            entry_part = np.concatenate([entry_part[plain], pairs // max(1, len(self.keys))])
            event_entry = place[of]
            event_entry[h] = len(plain) + which
            by_part = np.argsort(entry_part, kind="stable")
            rank = np.empty(len(by_part), np.int64)
            rank[by_part] = np.arange(len(by_part))
            self.by_event = np.argsort(rank[event_entry], kind="stable")
        # Without hot contexts nothing moves: keys are in the order of their parts.
        self.entry = entry_context[by_part]
        size = np.bincount(event_entry, minlength=len(entry_part))[by_part]
        at = np.searchsorted(entry_part[by_part], np.arange(parts + 1))
        ends = np.concatenate([[0], np.cumsum(size)])
        self.slices = [(r, int(at[r]), int(at[r + 1]), int(ends[at[r]]), int(ends[at[r + 1]])) for r in range(parts) if at[r] < at[r + 1]]
        self.size = size

    def asks(self) -> Iterator[tuple[int, bytes]]:
        walk, at = self.walk, self.live[self.places]
        n = added(walk.train[at][self.order].astype(np.int64), self.begin)
        near = np.minimum(np.round(-np.log2(walk.p[at[self.order[self.begin]]]) * GRAIN), 65535).astype(np.uint64)
        keys, total, symbols, n, near = self.keys[self.entry], self.total[self.entry], *(x[self.by_event] for x in (self.symbols(), n, near))
        for r, a, b, c, d in self.slices:
            yield r, pack(rising(keys[a:b]), total[a:b], self.size[a:b], symbols[c:d], n[c:d], near[c:d])

    def hear(self, told: dict[int, bytes], sums: tuple) -> tuple[np.ndarray, ...]:
        """By context: kept symbols, their mass, whether it is a state. By event: the count."""
        kept, mass, state = (np.zeros(len(self.keys), np.int64) for _ in range(3))
        n, counts = np.zeros(len(self.of), np.int64), np.zeros(len(self.of), np.int64)
        for r, a, b, c, d in self.slices:
            k, m, count = (x.astype(np.int64) for x in unpack(told[r]))
            e = self.entry[a:b]
            kept[e], state[e], mass[e] = k >> 1, k & 1, m
            counts[c:d] = count
        n[self.by_event] = counts
        if len(sums):
            i = np.minimum(np.searchsorted(sums[0], self.keys), len(sums[0]) - 1)
            hot = np.flatnonzero(sums[0][i] == self.keys)
            kept[hot], mass[hot] = sums[1][i[hot]], sums[2][i[hot]]
            state[hot] = divergence(self.total[hot], *(s[i[hot]] for s in sums[1:])) >= DIVERGENCE
        return kept, mass, state.astype(bool), n


class Walk:
    """A block on its way down the levels; `heard`: by level, the answer of each part."""

    def __init__(self, row: dict, told: Told):
        self.told = told
        self.lengths, self.tokens, self.own = (x.astype(np.int64) for x in unpack(row["tokens"]))
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.order = np.argsort(self.hashes)
        at = np.searchsorted(part_of(self.hashes[self.order], told.parts), np.arange(told.parts + 1)).tolist()
        self.slices = [(r, at[r], at[r + 1]) for r in range(told.parts) if at[r] < at[r + 1]]

    def ask_words(self) -> Iterator[tuple[int, bytes]]:
        h, own = self.hashes[self.order], self.own[self.order]
        for r, a, b in self.slices:
            yield r, pack(rising(h[a:b]), own[a:b])

    def begin(self, told: dict[int, bytes]) -> None:
        count = np.zeros(len(self.hashes), np.int64)
        for r, a, b in self.slices:
            count[self.order[a:b]] = unpack(told[r])[0]
        self.count, unseen = count[self.tokens], self.told.unseen
        self.p = np.where(self.count > 0, (1 - unseen) * self.count / max(self.told.n, 1), unseen)
        self.best, self.last = self.p.copy(), self.count  # last: the count of the event before, at each place

    def level(self, d: int, before: Level | None, key: np.ndarray | None, least: int) -> Level:
        """The level of depth d; `key` is the previous level's context key by live place."""
        if before is None:
            live, context = np.flatnonzero((self.place >= 1) & (np.concatenate([[0], self.last[:-1]]) >= least)), None
        else:
            known = np.zeros(len(self.tokens), np.uint64)
            known[before.live] = key
            live = np.flatnonzero((self.place >= d) & (known != 0) & (np.concatenate([[0], self.last[:-1]]) >= least))
            context = mix(known[live] * OLDER + self.hashes[self.tokens[live - d]])
        return Level(live, context, self.last[live - 1], self.last[live] >= least, self)

    def take(self, level: Level, heard: dict[int, bytes], sums: tuple) -> np.ndarray:
        """Go down a level: probabilities of its places; returns the context key of each live place, 0 where nothing follows."""
        kept, mass, state, n = level.hear(heard, sums)
        c = level.context
        at = level.live
        count = np.zeros(len(at), np.int64)
        count[level.places] = n[level.event]
        total = level.total.astype(np.float64)
        rest = 1 - (mass - DISCOUNT * kept) / total
        grown = kept[c] > 0
        p = np.maximum(count - DISCOUNT, 0.0) / total[c] + rest[c] * self.p[at]
        self.p[at] = np.where(grown, p, self.p[at])
        chosen = at[grown & state[c]]
        self.best[chosen] = self.p[chosen]
        self.last = np.zeros(len(self.tokens), np.int64)
        self.last[at] = count
        return np.where(grown, level.keys[c], np.uint64(0))

    def down(self, heard: dict[int, dict[int, bytes]], levels: int, least: int) -> tuple[Level | None, np.ndarray | None]:
        self.begin(heard[0])
        level = key = None
        for d in range(1, levels + 1):
            level = self.level(d, level, key, least)
            key = self.take(level, heard.get(d, {}), self.told.sums[d - 1])
        return level, key


def blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str, size: int = BLOCK) -> DataFrame:
    """One row per block: number, ids, whether held out, (symbols per text, symbol numbers, training counts of symbols), hashes of distinct symbols."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def row(ids: list, held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
            local = Numbered()
            tokens, lengths = [], []
            for t in texts:
                s = [*t.lower().split(), END]
                lengths.append(len(s))
                tokens.append(np.fromiter(map(local.__getitem__, s), np.int64, len(s)))
            tokens, lengths = np.concatenate(tokens), np.array(lengths, np.int64)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
            # Frequent words get small numbers, which compress well.
            order = np.argsort(-np.bincount(tokens, minlength=len(local)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tokens = rank[tokens]
            train = np.bincount(tokens[np.repeat(~np.array(held, bool), lengths)], minlength=len(order))
            columns = [pa.array([number]), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([pack(lengths, tokens, train)], pa.binary()), pa.array([hashes[order].tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "held", "tokens", "hashes"])

        ids, held, texts, have, id_type = [], [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                ids.append(i)
                held.append(bool(h))
                texts.append(t)
                have += len(t) + 8
                if have >= size:
                    yield row(ids, held, texts)
                    ids, held, texts, have, number = [], [], [], 0, number + 1
        if ids:
            yield row(ids, held, texts)

    return docs.select(F.col(id_col), held_out, F.col(text_col)).mapInArrow(run, f"block bigint, ids array<{kind}>, held array<boolean>, tokens binary, hashes binary")


def bucketed(scratch: Scratch, rows: DataFrame, tag: str) -> DataFrame:
    """`rows` as a table in the shared folder whose buckets are those of a shuffle by block, so that it joins what is dealt by block without moving."""
    spark, name = scratch.spark, f"tessera_{tag}_{uuid.uuid4().hex[:12]}"
    by_block = rows.write.option("path", f"{scratch.root}/{name}").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    scratch.written(lambda: by_block.saveAsTable(name))
    return spark.table(name)


ASK = "part int, block bigint, ask binary"


def frugal(f):
    """`f` for one group, after which freed memory goes back to the system: a worker meets many groups, and its neighbours need the room."""

    def run(*tables: pa.Table) -> pa.Table:
        import ctypes

        out = f(*tables)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        return out

    # Spark tells a group's function by its arguments.
    if f.__code__.co_argcount == 2:
        return lambda left, right: run(left, right)
    return lambda table: run(table)


def _heard(answers: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for part, level, told in zip(*(answers.column(c).to_pylist() for c in ("part", "level", "told"))):
        out.setdefault(level, {})[part] = told
    return out


def _row(table: pa.Table) -> dict:
    return {c: table.column(c)[0].as_py() for c in ("block", "held", "tokens", "hashes")}


def asked_words(table: DataFrame, told: Told) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, tokens, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                asks = list(Walk({"held": held, "tokens": tokens, "hashes": hashes}, told).ask_words())
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in asks], pa.int32()), pa.array([block] * len(asks), pa.int64()), pa.array([b for _, b in asks], pa.binary())], ["part", "block", "ask"])

    return table.select("block", "held", "tokens", "hashes").mapInArrow(run, ASK)


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ("block", "part", "level", "told", "key", "kept", "mass", "gain", "above")
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def told_words(asks: DataFrame) -> DataFrame:
    """Answers of level 0: the training count of every word asked; and of each part a row of sums (block -1): distinct words, occurrences, words that occur once."""

    def run(table: pa.Table) -> pa.Table:
        lists = [unpack(b) for b in table.column("ask").to_pylist()]
        keys, own = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lists]), np.concatenate([x[1] for x in lists]).astype(np.int64)
        order, begin, number = first_and_number(keys)
        count = added(own[order], begin)
        part, rows, at = table.column("part")[0].as_py(), [], 0
        for block, x in zip(table.column("block").to_pylist(), lists):
            rows.append((block, part, 0, pack(count[number[at : at + len(x[0])]]), None, None, None, None, None))
            at += len(x[0])
        rows.append((-1, part, 0, None, None, int((count > 0).sum()), int(count.sum()), float((count == 1).sum()), None))
        return _answers(rows)

    return asks.groupBy("part").applyInArrow(frugal(run), ANSWER)


def asked(table: DataFrame, answers: DataFrame, told: Told, d: int, least: int) -> DataFrame:
    """What the blocks ask at depth d, after the answers of all levels before."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asks = []
        if left.num_rows:
            walk = Walk(_row(left), told)
            level, key = walk.down(_heard(right), d - 1, least)
            asks = list(walk.level(d, level, key, least).asks())
        block = left.column("block")[0].as_py() if left.num_rows else 0
        return pa.Table.from_arrays([pa.array([r for r, _ in asks], pa.int32()), pa.array([block] * len(asks), pa.int64()), pa.array([b for _, b in asks], pa.binary())], ["part", "block", "ask"])

    return table.select("block", "held", "tokens", "hashes").groupBy("block").cogroup(answers.select("block", "part", "level", "told").groupBy("block")).applyInArrow(frugal(run), ASK)


def told_level(asks: DataFrame, d: int, told: Told, least: int) -> DataFrame:
    """Answers of depth d: by context the kept symbols (twice, plus 1 for a state) and their mass, by event the count (0 if not kept). Rows of block -1: this part's sums of a hot context."""

    def run(table: pa.Table) -> pa.Table:
        lists = [unpack(b) for b in table.column("ask")]
        lengths = [(len(x[0]), len(x[3])) for x in lists]
        keys = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lists])
        total, size, n, near = (np.concatenate([x[k].astype(t) for x in lists]) for k, t in ((1, np.int64), (2, np.int32), (4, np.int64), (5, np.uint16)))
        events = follow(np.repeat(keys, size), np.concatenate([x[3] for x in lists]))
        del lists
        _, first, context = first_and_number(keys)
        unique = np.zeros(len(first), np.uint64)
        unique[context] = keys
        totals = np.zeros(len(first), np.int64)
        totals[context] = total
        of = np.repeat(context, size)
        order, begin, event = first_and_number(events)
        count = added(n[order], begin)
        count[count < least] = 0
        one = order[begin]
        del order, n, events, size
        above, c = np.exp2(-near[one].astype(np.float64) / GRAIN), of[one]
        keep = count > 0
        add = lambda w: np.bincount(c[keep], w[keep], len(first))
        kept, mass = add(np.ones(len(one))).astype(np.int64), add(count.astype(np.float64)).astype(np.int64)
        gain, near_all = add(count * np.log(np.maximum(count, 1) / above)), add(above)
        state = divergence(totals, kept, mass, gain, near_all) >= DIVERGENCE
        part, rows, a, e = table.column("part")[0].as_py(), [], 0, 0
        for block, (contexts, asked_here) in zip(table.column("block").to_pylist(), lengths):
            i, j = context[a : a + contexts], event[e : e + asked_here]
            rows.append((block, part, d, pack(kept[i] << 1 | state[i], mass[i], count[j]), None, None, None, None, None))
            a, e = a + contexts, e + asked_here
        for i in np.flatnonzero((totals >= told.hot) & (kept > 0)):
            rows.append((-1, part, d, None, int(unique[i].astype(np.int64)), int(kept[i]), int(mass[i]), float(gain[i]), float(near_all[i])))
        return _answers(rows)

    return asks.groupBy("part").applyInArrow(frugal(run), ANSWER)


def hot_sums(answers: DataFrame) -> tuple:
    """Sums of the hot contexts of a level, sorted by key; there are at most 1 / HOT_SHARE."""
    sums = answers.where("block = -1").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("kept", "mass", "gain", "above"))).toArrow()
    if not sums.num_rows:
        return ()
    key = sums.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return (key[order], *(sums.column(c).to_numpy()[order] for c in ("kept", "mass", "gain", "above")))


def score(
    spark: SparkSession, docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, block: int = BLOCK, hot: int = HOT
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: learnt from rows that are not held out, for all rows."""
    scratch = Scratch(spark, "lm")
    table = bucketed(scratch, blocks(docs, held_out, id_col, text_col, block), "blocks")
    told = Told(parts=max(PARTS, table.count() // BLOCKS_A_PART))
    answers = [scratch.table(told_words(asked_words(table, told)), "words")]
    distinct, n, once = answers[0].where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("kept", "mass", "gain"))).head()
    told = Told(n, distinct, once, told.parts, max(hot, int(n * HOT_SHARE)))
    every = lambda: reduce(DataFrame.union, answers).where("block >= 0")
    for d in range(1, depth + 1):
        asks = asked(table, every(), told, d, least)
        answers.append(scratch.table(told_level(asks, d, told, least), f"level{d}"))
        told = Told(n, distinct, once, told.parts, told.hot, (*told.sums, hot_sums(answers[-1])))
    kind, log_all = docs.schema[id_col].dataType.simpleString(), float(np.log10(n + distinct + 1))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], left.schema.field("ids").type.value_type), pa.array([], pa.bool_()), *(pa.array([], pa.int64()) for _ in range(3)), *(pa.array([], pa.float64()) for _ in range(2))], names)
        walk = Walk(_row(left), told)
        walk.down(_heard(right), depth, least)
        begin, lengths = np.cumsum(walk.lengths) - walk.lengths, walk.lengths
        add = lambda x: pa.array(np.add.reduceat(x, begin))
        base = np.add.reduceat(np.log10(walk.count + 1), begin) - lengths * log_all
        columns = [left.column("ids").combine_chunks().flatten(), left.column("held").combine_chunks().flatten(), pa.array(lengths), add((walk.count > 0).astype(np.int64)), pa.array(np.full(len(lengths), n, np.int64)), pa.array(base), add(np.log10(walk.best))]
        return pa.Table.from_arrays(columns, names)

    schema = f"{id_col} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    joined = table.groupBy("block").cogroup(every().select("block", "part", "level", "told").groupBy("block"))
    return joined.applyInArrow(frugal(add_up), schema)
