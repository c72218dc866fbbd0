"""Toxicity: a factorization machine over the hashed terms of a text, trained here in numpy.

A text's terms are its words without case and punctuation, and the beginnings (3 to 7 characters) of those words, all hashed. A
word's value is 1 where it occurs; a beginning's value is its share of the text's words, 1 from `DENSE` on; all are then divided by the
fourth root of the text's number of words, so that long texts do not score by their length. The score is sigmoid(w0 + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j): the pair
term, computed from sums of factor vectors in linear time, says what two terms mean together (an insult and a group's name) that
neither means alone.

Learning takes a bounded sample (`SAMPLE` labelled rows). Terms are hashed into `SPACE` places for words and as many for beginnings,
and each place that a term of the sample falls into has a weight and factors; none is chosen beforehand by what it tells alone, since
a pair may tell what neither part does. Against chance, weights are held back by `LINEAR` times the deviation that the mean gradient
of a term has by chance (its rows and values say it): a weight below that is 0; factors decay by a multiple of it. A part of the
sample (`ASIDE`) is not learnt from: it chooses among the multiples `PAIRS` and sets the scale and offset of the logit, so that scores
are probabilities. Scoring takes all
words of every whole text. Null, empty and blank texts have no terms and score as the offset says. Repeated rows repeat their score;
only the id and text columns are read. Without labelled rows every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .langid import _sigmoid
from .quality_mil import groups
from .samples import labelled

SAMPLE = 6000
#: Places of words, and of beginnings.
SPACE = 1 << 17
LINEAR, PAIRS = 1.0, (8.0, 60.0)
#: Value of a word of a text of one word.
SCALE = 2.0
#: Part of the sample that sets scale and offset.
ASIDE = 0.2
FACTORS = 8
BEGINNINGS = (3, 4, 5, 6, 7)
WIDTH = 1 + len(BEGINNINGS)
DENSE = 0.02
NOT_WORD = re.compile(r"[\W_]+")


def hashed_terms(word: bytes) -> list[int]:
    """Places of a word's term and of its beginnings; the lowest bit tells a beginning. 0 where there is none."""
    import xxhash

    term = NOT_WORD.sub("", word.decode("utf-8", "replace").lower())
    h = lambda t: xxhash.xxh3_64_intdigest(t.encode()) % SPACE + 1 << 1
    return [h(term) if term else 0, *(h(term[:k]) | 1 if len(term) >= k else 0 for k in BEGINNINGS)]


class Terms(dict):
    """word -> row of `table`, which holds what `of` says of a word's terms. Bounded; forgets everything at `most`."""

    def __init__(self, of=lambda hashes: hashes, most: int = 300_000):
        self.of, self.most, self.table = of, most, np.zeros((most, WIDTH), np.int64)

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, value) of the texts' terms, by text."""
        split = [t.split() for t in texts]
        distinct = set().union(*split) if split else set()
        new = distinct - self.keys()
        if len(self) + len(new) > self.most:
            self.clear()
            new = distinct
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), WIDTH), np.int64)
        if new:
            at = len(self)
            self.table[at : at + len(new)] = self.of(np.array([hashed_terms(w) for w in new], np.int64))
            self.update(zip(new, range(at, at + len(new))))
        n = np.array([len(s) for s in split], np.int64)
        ids = np.fromiter((self[w] for s in split for w in s), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(n)), n)
        some = (self.table[:, 0] != 0) | (self.table[:, 1:] != 0).any(1)
        hit = some[ids]
        doc, term = np.repeat(doc[hit], WIDTH), self.table[ids[hit]].ravel()
        doc, term = doc[term != 0], term[term != 0]
        key = np.sort(doc << 24 | term)  # a place, or a row, and its lowest bit take less than 24 bits
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(begin, len(key)))
        doc, term = key[begin] >> 24, key[begin] & (1 << 24) - 1
        words = np.maximum(n[doc], 1)
        return doc, term, np.where(term & 1, np.minimum(1.0, count / (words * DENSE)), 1.0) * SCALE / words**0.25


class FactorizationMachine:
    """Weights by row; row 0 is all zero and stands for unknown terms. `terms`: the sorted hashes that have rows 1, 2, ..."""

    def __init__(self, terms: np.ndarray, factors: int = FACTORS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.terms = np.sort(terms)
        self.p = {"w0": np.zeros(1), "w": np.zeros(len(terms) + 1), "v": 0.02 * rng.standard_normal((len(terms) + 1, factors)), "scale": np.ones(1)}
        self.p["v"][0] = 0

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Twice the row, plus the bit that tells a beginning; 0 for unknown terms."""
        if not len(self.terms):
            return np.zeros_like(hashes)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, (i + 1) * 2 + (hashes & 1), 0)

    def sums(self, doc: np.ndarray, row: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits before scale and offset, the texts' sums of factors, and the terms' factors times their values; `doc` rises."""
        p = self.p
        v = p["v"][row] * x[:, None]
        sums = np.zeros((n, v.shape[1]))
        if len(row):
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            sums[doc[begin]] = np.add.reduceat(v, begin, 0)
        return np.bincount(doc, p["w"][row] * x, n) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (v**2).sum(1), n)), sums, v

    def logits(self, doc: np.ndarray, row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return self.p["scale"][0] * self.sums(doc, row, x, n)[0] + self.p["w0"][0]

    def gradients(self, doc: np.ndarray, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(y)
        z, sums, v = self.sums(doc, row, x, n)
        d = (_sigmoid(np.clip(z + self.p["w0"][0], -30, 30)) - y) / n
        by, size = d[doc] * x, len(self.p["w"])
        pairs = [np.bincount(row, by * (sums[doc, k] - v[:, k]), size) for k in range(v.shape[1])]
        return {"w0": np.array([d.sum()]), "w": np.bincount(row, by, size), "v": np.stack(pairs, 1)}


def calibrate(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and offset of logits by logistic regression (Newton's steps), with a little weight on the plain share."""
    a, b, prior = 1.0, np.log(share / (1 - share)), 1.0
    for _ in range(30):
        p = _sigmoid(np.clip(a * z + b, -30, 30))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * z).sum() + prior * 0.1 * (a - 1), (p - y).sum()])
        h = np.array([[(w * z * z).sum() + prior * 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(np.clip(a, 0.1, 20)), float(b)


def fit(doc: np.ndarray, term: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int | None = None, seed: int = 5) -> FactorizationMachine:
    """The machine for documents given as (doc, term, value) sorted by doc; every term gets weights. Of several decays of factors that with the least loss aside."""
    n = len(y)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    begin = np.searchsorted(doc, np.arange(n + 1))
    mixed = np.random.default_rng(seed).permutation(n)
    aside, learnt = np.sort(mixed[: int(ASIDE * n)]), mixed[int(ASIDE * n) :]
    found = []
    for pairs in PAIRS if len(aside) else PAIRS[-1:]:
        model = FactorizationMachine(np.unique(term), seed=seed)
        row = (model.rows(term) >> 1).astype(np.int32)

        def of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in some])
            return np.repeat(np.arange(len(some)), begin[some + 1] - begin[some]), row[at], x[at].astype(np.float64)  # noqa: B023

        noise = np.sqrt(np.bincount(row, x * x, len(model.p["w"])) * share * (1 - share)) / n
        learn(model, of, learnt, y, share, noise, pairs, epochs or int(np.clip(20_000 // max(1, n), 6, 60)))
        loss = 0.0
        if len(aside):
            z = model.sums(*of(aside), len(aside))[0]
            model.p["scale"][:], model.p["w0"][:] = calibrate(z, y[aside], share)
            q = np.clip(_sigmoid(np.clip(model.p["scale"][0] * z + model.p["w0"][0], -30, 30)), 1e-9, 1 - 1e-9)
            loss = -float(np.mean(y[aside] * np.log(q) + (1 - y[aside]) * np.log(1 - q)))
        found.append((loss, len(found), model))
    return min(found)[2]


def learn(model: FactorizationMachine, of, learnt: np.ndarray, y: np.ndarray, share: float, noise: np.ndarray, pairs: float, epochs: int, batch: int = 128, rate: float = 0.1, seed: int = 5) -> None:
    """Steps of adaptive gradients over the documents `learnt`; `noise` is the deviation of a term's mean gradient by chance."""
    rng, p = np.random.default_rng(seed), model.p
    seen = {"w": np.full(len(p["w"]), 1e-8), "v": np.full(len(p["w"]), 1e-8)}
    p["w0"][:] = np.log(share / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(learnt)
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            g = model.gradients(*of(some), y[some])
            g["v"] += (pairs * noise)[:, None] * p["v"]
            seen["w"] += g["w"] ** 2
            seen["v"] += (g["v"] ** 2).mean(1)
            step = rate / np.sqrt(seen["w"])
            w = p["w"] - step * g["w"]
            p["w"][:] = np.sign(w) * np.maximum(np.abs(w) - step * LINEAR * noise, 0)
            p["v"] -= (0.3 * rate / np.sqrt(seen["v"]))[:, None] * g["v"]
            p["w0"] -= rate * g["w0"]
            p["w"][0] = p["v"][0] = 0


_TERMS: dict[int | None, Terms] = {}


def terms(model: FactorizationMachine | None = None) -> Terms:
    """One memory per worker and model."""
    key = hash((model.terms.tobytes(), model.p["w"].tobytes())) if model else None
    if key not in _TERMS:
        _TERMS.clear()
        _TERMS[key] = Terms(model.rows) if model else Terms()
    return _TERMS[key]


def train(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **how) -> FactorizationMachine | None:
    """The machine fitted to a bounded sample of the labelled rows that `train` admits.

    The driver gets the places and values of all terms of the sample, packed by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, y = text_bytes(batch.column(1)), batch.column(0), batch.column(2)
            for a, b in groups(texts):
                doc, term, x = terms().values(texts[a:b])
                cut = np.searchsorted(doc, np.arange(1, b - a))
                packed = (pa.array([c.tobytes() for c in np.split(v, cut)], pa.binary()) for v in (term.astype(np.int32), x.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([ids[a:b], y[a:b], *packed], ["id", "y", "term", "x"])

    found = labelled(docs, labels, label, train, sample, id_col, text_col)
    table = found.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, term binary, x binary").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("id", "ascending"), ("term", "ascending")])
    y = table.column("y").to_numpy()
    parts = table.column("term").to_pylist()
    doc, term = np.repeat(np.arange(len(parts), dtype=np.int32), [len(t) // 4 for t in parts]), np.frombuffer(b"".join(parts), np.int32)
    del parts
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32)
    del table  # what is left is 12 bytes a term of a text
    return fit(doc, term, x, y, **how)


def score(docs: DataFrame, model: FactorizationMachine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = text_bytes(batch.column(1)), []
            for a, b in groups(texts):
                doc, row, x = terms(model).values(texts[a:b])
                out.append(_sigmoid(np.clip(model.logits(doc, row >> 1, x, b - a), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, score double")
