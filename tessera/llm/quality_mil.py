"""Quality classifier: attention-based multiple-instance learning over the passages of a document, trained here in numpy.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded as a vector: shares of character classes and word
shapes, repetition within the passage, and hashed words. One layer embeds it, gated attention (tanh times sigmoid) weighs it
against the document's other passages, and the weighted sum of embeddings gives the document's score. Attention is learned from
document labels alone.

Learning takes a bounded sample (`SAMPLE` labelled rows), with every passage of its texts. Scoring takes every passage of every whole
text; texts are scored in groups of about `GROUP` words, and a longer one by itself, so memory follows the longest text (about its
own size in vectors). Null, empty and blank texts are one passage without words, whose vector is zero but for its own flag. Repeated rows
repeat their score; only the id and text columns are read. Without labelled rows every score is 0.5. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .langid import Adam, _sigmoid
from .samples import labelled

SAMPLE = 4000
PASSAGE = 64
HASHED = 64
HIDDEN = 24
GATE = 16
SHAPES = 12
SIZE = SHAPES + 4 + HASHED
#: Words in a group of texts that is scored together.
GROUP = 400_000
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]|_")


def shape(word: str) -> list[float]:
    """What one word adds to its passage's vector: lengths, character classes, shapes."""
    n = len(word)
    letters = sum(c.isalpha() for c in word)
    upper = sum(c.isupper() for c in word)
    digits = sum(c.isdigit() for c in word)
    symbols = len(SYMBOL.findall(word))
    return [
        min(n, 40) / 8, letters / n, upper / n, digits / n, symbols / n, (n - letters - digits - symbols) / n,
        float(letters == 0), float(n <= 3), float(n > 12), float(letters > 1 and upper == letters), float(word[-1] in ".?!" and word[-2:-1] not in "!?"), float(word[-2:] in ("!!", "??")),
    ]


class Shapes(dict):
    """word -> row of `table` (its shape) and bucket; bounded, forgets everything at `most`."""

    def __init__(self, most: int = 300_000):
        import xxhash

        self.most, self.hash = most, xxhash.xxh3_64_intdigest
        self.table, self.bucket = np.zeros((most, SHAPES), np.float32), np.zeros(most, np.int64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table[: self.most])])
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket[: self.most])])
        self.table[i] = shape(word.decode("utf-8", "replace"))
        self.bucket[i] = self.hash(word.lower()) % HASHED
        self[word] = i
        return i

    def passages(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all passages of the texts, and the row at which each text's passages begin."""
        if len(self) > self.most:
            self.clear()
            self.table, self.bucket = self.table[: self.most], self.bucket[: self.most]
        split = [t.split() for t in texts]
        n = np.array([len(s) for s in split])
        ids = np.fromiter((self[w] for s in split for w in s), np.int64, int(n.sum()))
        bags = np.maximum(1, -(-n // PASSAGE))
        first = np.concatenate([[0], np.cumsum(bags)])
        start = np.concatenate([[0], np.cumsum(n)])[:-1]
        doc = np.repeat(np.arange(len(n)), n)
        passage = first[doc] + (np.arange(len(ids)) - start[doc]) // PASSAGE
        out = np.zeros((first[-1], SIZE), np.float32)
        if len(ids):
            begin = np.flatnonzero(np.diff(passage, prepend=-1))
            rows, count = passage[begin], np.diff(np.append(begin, len(ids)))[:, None]
            out[rows, :SHAPES] = np.add.reduceat(self.table[ids], begin, 0) / count
            distinct = np.unique(passage * np.int64(1 << 32) + ids) >> 32
            out[rows, SHAPES] = np.bincount(distinct, minlength=first[-1])[rows] / count[:, 0]
            out[rows, SHAPES + 1] = np.minimum(count[:, 0], PASSAGE) / PASSAGE
            hashed = np.bincount(passage * HASHED + self.bucket[ids], minlength=first[-1] * HASHED).reshape(-1, HASHED)
            out[rows, SHAPES + 4 :] = np.sqrt(hashed[rows] / count)
        # The document's own size tells a stub from a text; its share of words seen before tells a loop from a text.
        size = np.minimum(n, 512) / 512
        seen = np.ones(len(n))
        if len(ids):
            pairs = np.unique(doc * np.int64(1 << 32) + ids) >> 32
            seen = np.where(n > 0, np.bincount(pairs, minlength=len(n)) / np.maximum(np.minimum(n, 64), 1), 0)
        out[:, SHAPES + 2] = np.repeat(size, bags)
        out[:, SHAPES + 3] = np.repeat(np.minimum(seen, 1.5), bags)
        return out, first


class GatedAttention:
    """Embedding, gated attention and output layer: score = sigmoid(sum of attention * embedding . w + b)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        u = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {
            "W": u(SIZE, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "V": u(HIDDEN, GATE), "U": u(HIDDEN, GATE), "t": u(GATE, 1)[:, 0],
            "w": u(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32), "mean": np.zeros(SIZE, np.float32), "scale": np.ones(SIZE, np.float32),
        }

    def embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        h = np.tanh(((x - p["mean"]) * p["scale"]) @ p["W"] + p["a"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, v, u, (v * u) @ p["t"]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each bag; bags are consecutive rows of x, none is empty."""
        h, _, _, e = self.embed(x)
        begin, n = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), n))
        z = np.add.reduceat(h * e[:, None], begin, 0) / np.add.reduceat(e, begin)[:, None]
        return _sigmoid((z @ self.p["w"] + self.p["b"]).astype(np.float64))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p = self.p
        h, v, u, e = self.embed(x)
        begin, n = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), n))
        a = e / np.repeat(np.add.reduceat(e, begin), n)
        z = np.add.reduceat(h * a[:, None], begin, 0)
        d = (_sigmoid(z @ p["w"] + p["b"]) - y) / len(y)
        g = {"w": z.T @ d, "b": np.array([d.sum()], np.float32)}
        dz = np.repeat(d[:, None] * p["w"], n, 0)
        dh = a[:, None] * dz
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, begin), n))
        g["t"] = (v * u).T @ de
        gate = de[:, None] * p["t"]
        dv, du = gate * u * (1 - v * v), gate * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh += dv @ p["V"].T + du @ p["U"].T
        dh *= 1 - h * h
        g["W"], g["a"] = ((x - p["mean"]) * p["scale"]).T @ dh, dh.sum(0)
        for k in ("W", "V", "U", "w"):
            g[k] = g[k] + decay * p[k]
        return g


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> GatedAttention:
    """The model for bags of passage vectors with 0/1 labels."""
    model, rng = GatedAttention(seed), np.random.default_rng(seed)
    every = np.concatenate(bags)
    model.p["mean"] = every.mean(0)
    model.p["scale"] = 1 / (every.std(0) + 0.05)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.p["b"][:] = np.log(share / (1 - share))
    learned = {k: v for k, v in model.p.items() if k not in ("mean", "scale")}
    adam = Adam(learned, rate)
    for epoch in range(epochs):
        adam.rate = rate * 0.9**epoch
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = [bags[k] for k in order[i : i + batch]]
            first = np.concatenate([[0], np.cumsum([len(b) for b in some])])
            adam.step(model.gradients(np.concatenate(some), first, y[order[i : i + batch]].astype(np.float32), decay))
    return model


_SHAPES: list[Shapes] = []


def shapes() -> Shapes:
    if not _SHAPES:
        _SHAPES.append(Shapes())
    return _SHAPES[0]


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP words (six bytes each) together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 6 * GROUP:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def train(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **how) -> GatedAttention | None:
    """The model fitted to a bounded sample of the labelled rows that `train` admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y, out = text_bytes(batch.column(1)), batch.column(2), []
            for a, b in groups(texts):
                x, first = shapes().passages(texts[a:b])
                out += [x[i:j].astype("<f4").tobytes() for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(out, pa.binary()), y], ["id", "x", "y"])

    rows = labelled(docs, labels, label, train, sample, id_col, text_col).mapInArrow(run, "id string, x binary, y int").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["id"], bytes(r["x"])))
    bags = [np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, SIZE) for r in rows]
    return fit(bags, np.array([r["y"] for r in rows]), **how)


def score(docs: DataFrame, model: GatedAttention | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return docs.select(F.col(id_col), F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            out = [model.score(*shapes().passages(texts[a:b])) for a, b in groups(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, score double")
