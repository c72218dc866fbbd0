"""Packing: vector bin packing of examples into training sequences by the dot-product heuristic.

Every example has three sizes - tokens, segments (1) and loss-bearing tokens - and a sequence has a limit for each. A sequence is
filled by taking, again and again, that example among those that still fit whose size vector has the largest dot product with
the room that is left (each size as a share of its limit); when none fits, the next sequence is begun. Examples with equal size
vectors are one type with a count, so a pick costs as much as there are types.

Of a document's ids the first `PROMPT` share is its prompt and bears no loss; all others, the end id among them, do. A document that
fits a sequence is one piece. Of a longer one, what bears loss is cut into pieces of the limit on loss and a rest; the prompt gives
each of the full ones a piece for the room that the limit leaves beside it, and is cut at the limit on tokens for the rest.

Pieces are dealt by hash into blocks of about `BLOCK` (counted by rows and bytes of text), each packed for itself: its last sequence is
the only one with much padding. Pieces are dealt by their row's place in its partition, so repeated rows and rows of one id are spread,
and a task that runs again over the same partition gives the same. Sequence ids are block * 2**32 + number, so they are unique without
any global order.

Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; they are interchangeable. Columns other
than the id and the text are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Examples in a block, on average.
BLOCK = 8192
END_ID = 1
#: Share of a document's ids that is its prompt, as 1 / PROMPT.
PROMPT = 8


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 32
    loss: int = 1984


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each example. Every example must fit an empty sequence."""
    n = len(tokens)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, offset
    sizes = np.stack([tokens, np.ones(n, np.int64), loss], 1).astype(np.int64)
    most = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
    if (sizes > most).any():
        raise ValueError("an example is larger than a sequence")
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    begin = np.concatenate([[0], np.cumsum(left)[:-1]])
    shares = kinds / most
    room, number, at = most.copy(), -1, 0
    # Examples that fill a sequence by themselves need no search.
    for k in np.flatnonzero(kinds[:, 0] == limits.tokens):
        i = order[begin[k] : begin[k] + left[k]]
        sequence[i] = number + 1 + np.arange(len(i))
        number += len(i)
        left[k] = 0
    room[0], todo = 0, int(left.sum())
    for _ in range(todo):
        top = np.searchsorted(kinds[:, 0], room[0], "right")  # kinds are sorted by tokens
        fits = (left[:top] > 0) & (kinds[:top] <= room).all(1)
        if not fits.any():
            room, number, at, top = most.copy(), number + 1, 0, len(kinds)
            fits = left > 0
        k = int(np.argmax(np.where(fits, shares[:top] @ (room / most), -1.0)))
        i = order[begin[k] + left[k] - 1]
        left[k] -= 1
        sequence[i], offset[i] = number, at
        at += int(kinds[k, 0])
        room -= kinds[k]
    return sequence, offset


#: Chunks that are cut into pieces here: ASCII without the apostrophe (contractions have rules of their own), letters of Latin-1.
PLAIN = re.compile(rb"(?:[\x21-\x26\x28-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
#: Bytes of the longest chunk that is merged here, many chunks at a time; longer ones go to the library.
LONGEST = 64
#: Bytes of text whose new chunks are learnt together.
GROUP = 4 << 20
NEVER = np.int32(1 << 30)
#: By byte: 0 a letter (those of Latin-1 are two bytes), 1 a digit, which is a piece of its own, 2 another.
CLASS = np.full(256, 2, np.int8)
CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 0
CLASS[ord("0") : ord("9") + 1] = 1


class Merges:
    """The vocabulary's merges as a hash table over pairs of ids, applied to many pieces at once.

    In every round each piece makes its merge of least rank, the leftmost of equal ones, which is the order of a merge loop over one
    piece; a piece without a merge is done.
    """

    def __init__(self, model: dict, end: str):
        vocab = model["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letter[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in c], np.int64) for c in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key, bits = left << 20 | right, 20
        first = np.unique(key, return_index=True)[1]  # of a merge that is told twice the first counts
        self.shift = np.uint64(64 - bits)
        slots = np.full(1 << bits, -1, np.int64)
        for k, r in zip(key[first].tolist(), first.tolist()):
            at = (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - bits
            while slots[at] >= 0:
                at = at + 1 & (1 << bits) - 1
            slots[at] = r
        self.slots, self.key, self.made = slots, np.append(key, -1), made.astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.slots[at]
        out = np.where((found >= 0) & (self.key[found] == key), found, NEVER).astype(np.int32)
        todo = np.flatnonzero((found >= 0) & (self.key[found] != key))
        while len(todo):
            at[todo] = at[todo] + 1 & len(self.slots) - 1
            f = self.slots[at[todo]]
            same = (f >= 0) & (self.key[f] == key[todo])
            out[todo[same]] = f[same]
            todo = todo[(f >= 0) & ~same]
        return out

    def ids(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces of `raw` bytes, none empty, one after the other, and their numbers."""
        ends = np.cumsum(size)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        owner = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(symbol), NEVER)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self.rank(symbol[same], symbol[same + 1])
        done_owner, done_symbol, pieces = [], [], len(size)
        while len(symbol):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(owner)))
            if (over := least == NEVER).any():
                gone = np.repeat(over, size)
                done_owner.append(owner[gone])
                done_symbol.append(symbol[gone])
                symbol, owner, rank, least, size = symbol[~gone], owner[~gone], rank[~gone], least[~over], size[~over]
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.diff(owner[at], prepend=-1) != 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            for i in (place, place[place > 0] - 1):
                i = i[i + 1 < len(owner)]
                within = owner[i] == owner[i + 1]
                rank[i[~within]] = NEVER
                i = i[within]
                rank[i] = self.rank(symbol[i], symbol[i + 1])
            rank[-1:] = NEVER
        owner, symbol = (np.concatenate([x[:0], *y]) for x, y in ((owner, done_owner), (symbol, done_symbol)))
        order = np.argsort(owner, kind="stable")
        return symbol[order].astype("<u4"), np.bincount(owner, minlength=pieces)


class ChunkIds(dict):
    """bytes between blanks -> number of its ids in `flat`. The vocabulary drops white space, so a text's ids are those of its chunks, one after the other.

    New chunks are numbered as they are met and learnt together: their pieces are found by byte classes and merged at once. Chunks
    of other characters, long ones, and those that may hold a special string go to the library. Bounded; forgets everything at `most`.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of, self.most, self.new = Tokenizer.from_file(path), most, []
        self.of.no_truncation()
        self.of.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model, model["end_of_word_suffix"])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.begin, self.size, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n

    def keep(self, number: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        while len(self.begin) < len(self):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[number] = self.used + np.cumsum(size) - size
        self.size[number] = size
        self.used += len(ids)

    def learn(self) -> None:
        new, first = self.new, len(self) - len(self.new)
        self.new = []
        plain = [len(c) <= LONGEST and PLAIN.fullmatch(c) is not None and b"<|" not in c for c in new]
        here = list(compress(new, plain))
        if here:
            length = np.fromiter(map(len, here), np.int64, len(here))
            raw = np.frombuffer(b"".join(here), np.uint8).copy()
            raw[(raw >= ord("A")) & (raw <= ord("Z"))] += 32
            second = np.flatnonzero(raw == 0xC3) + 1
            raw[second[raw[second] <= 0x9E]] += 32
            kind = CLASS[raw]
            cut = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
            cut[np.cumsum(length)[:-1] - 1] = True
            begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
            ids, size = self.merges.ids(raw, np.diff(np.append(begin, len(raw))))
            first_piece = np.searchsorted(begin, np.cumsum(length) - length)
            self.keep(first + np.flatnonzero(plain), ids, np.add.reduceat(size, first_piece))
        other = [k for k, p in enumerate(plain) if not p]
        for i in range(0, len(other), 1000):
            some = [x.ids for x in self.of.encode_batch_fast([new[k].decode("utf-8", "replace") for k in other[i : i + 1000]], add_special_tokens=False)]
            self.keep(first + np.array(other[i : i + 1000]), np.array([t for x in some for t in x], "<u4"), np.array([len(x) for x in some], np.int64))

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each text."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (size < GROUP or end == begin):
                size += len(texts[end])
                end += 1
            if len(self) > self.most:
                self.forget()
            # Special strings count as they are written; elsewhere the vocabulary has no upper case.
            split = [(t if b"<|" in t else t.lower()).split() for t in texts[begin:end]]
            words = np.array([len(s) for s in split])
            number = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(words.sum()))
            del split
            if self.new:
                self.learn()
            some = self.size[number]
            ends = np.cumsum(some)
            packed = self.flat[np.arange(int(some.sum())) + np.repeat(self.begin[number] - (ends - some), some)].tobytes()
            at = 0
            for to in np.concatenate([[0], ends])[np.cumsum(words)].tolist():
                yield packed[4 * at : 4 * to]
                at = to
            begin = end


_CHUNKS: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One memory per worker and vocabulary."""
    if path not in _CHUNKS:
        _CHUNKS[path] = ChunkIds(path)
    return _CHUNKS[path]


def cuts(n: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, length, loss-bearing ids) of the pieces of a document of n ids."""
    prompt = n // PROMPT
    if n <= limits.tokens and n - prompt <= limits.loss:
        return [(0, n, n - prompt)]
    out, at, beside = [], 0, limits.tokens - limits.loss
    for _ in range((n - prompt) // limits.loss if beside else 0):
        if at + beside > prompt:
            break
        out.append((at, beside, 0))
        at += beside
    out += [(k, min(limits.tokens, prompt - k), 0) for k in range(at, prompt, limits.tokens)]
    most = min(limits.loss, limits.tokens)
    return out + [(k, min(most, n - k), min(most, n - k)) for k in range(prompt, n, most)]


def pieces(docs: DataFrame, path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each document and the end id, cut into pieces: id, start, length, ids_crc32, doc_tokens, loss_tokens, and `_deal`, a number by which rows can be dealt."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "_deal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunks, deal = chunk_ids(path), TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            row, start, length, crc, total, loss = [], [], [], [], [], []
            for i, ids in enumerate(chunks.texts(text_bytes(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                for at, size, bearing in cuts(n, limits):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(n)
                    loss.append(bearing)
            numbers = np.arange(deal, deal + len(row))
            deal += len(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, loss, numbers))], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{c} bigint" for c in names[1:]))


def pack(examples: DataFrame, n_blocks: int, key: list[str], deal: list[str] | None = None, tokens: str = "length", loss: str = "loss_tokens", limits: Limits = Limits()) -> DataFrame:
    """`examples` with sequence_id and offset. `key`: columns that order rows; `deal`: columns that deal them to blocks, the key by default."""
    dealt = examples.withColumn("_block", F.pmod(F.xxhash64(*(deal or key)), F.lit(n_blocks)).cast("long"))
    names = examples.columns

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable", na_position="first").reset_index(drop=True)
        sequence, offset = pack_block(pdf[tokens].to_numpy(np.int64), pdf[loss].to_numpy(np.int64), limits)
        return pdf[names].assign(sequence_id=(np.int64(group[0]) << np.int64(32)) + sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("_block").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole documents to pieces in sequences within the limits: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).head()
    # A piece of a long text has over 2 bytes an id.
    n_blocks = max(1, -(-(rows + size // (2 * limits.tokens)) // BLOCK))
    return pack(pieces(docs, path, limits, id_col, text_col), n_blocks, [id_col, "start", "ids_crc32", "length"], ["_deal"], limits=limits).select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )
