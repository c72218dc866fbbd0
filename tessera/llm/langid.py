"""Language identification: a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads the lower-cased (A-Z) UTF-8 bytes of a text, forwards and backwards, and gives every position a distribution over the
languages learned; a document's distribution is the softmax of the mean log probability over all its positions. Blanks and
punctuation are read like other bytes, so a position knows the words around it. Texts are read in windows of `CORE` positions; each
direction starts `MARGIN` bytes before the window's first position (in its direction of reading), so a position's state has at least
that many bytes of context, or all there are. The network's gates forget within that distance. Many windows run at once, a text of
any length in windows of its own, so memory is bounded. Byte 0 stands for what is beyond a text's ends: it leaves the state as it is.

Gates are hard sigmoids, the candidate is a tanh whose recurrent part the reset gate scales. Training is by backpropagation
through time on windows of a bounded sample of labelled documents: by a hash of the id, of each language at most about `SAMPLE` rows
and as many as hold about `BYTES` bytes. The sampled texts are used whole: windows are drawn from all of them, alike by language.

Null text and text without a letter (`str.isalpha`) is `und` with score 0. Repeated rows repeat their result; only the id, text and
lang columns are read. If no labelled row is left to learn from (as with an empty table), every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .samples import GRAIN

SAMPLE = 1000
BYTES = 4_000_000
HIDDEN = 8
EMBED = 12
#: Positions of a window, and bytes of context before it in either direction.
CORE, MARGIN = 112, 16
#: Windows that run together, and bytes of text whose windows are dealt with together.
TOGETHER, GROUP = 1024, 4 << 20
#: Training: steps, windows in a step, bytes in a window.
STEPS, BATCH, LENGTH = 320, 192, 96


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Gates in the order update, reset, candidate; index 0 of a weight is the forward direction, 1 the backward one; a softmax over both states per position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        u = lambda *shape, fan: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
        k, h = len(labels), hidden
        self.p = {
            "E": u(256, embed, fan=embed), "W": u(2, 3 * h, embed, fan=embed), "a": np.zeros((2, 3 * h, 1), np.float32), "U": 0.5 * u(2, 3 * h, h, fan=h),
            "O": u(2, k, h, fan=2 * h), "c": np.zeros((k, 1), np.float32),
        }

    def table(self) -> np.ndarray:
        """What each byte adds to the gates of either direction; byte 0 shuts the update gate."""
        t = self.p["W"] @ self.p["E"].T + self.p["a"]
        t[:, : self.hidden] += 0.5  # a hard sigmoid is x + 1/2, kept between 0 and 1
        t[:, self.hidden : 2 * self.hidden] += 0.5
        t[:, : self.hidden, 0] = -1e4
        return np.ascontiguousarray(t)

    def logits(self, x: np.ndarray, skip: int = 0) -> np.ndarray:
        """[position, language, window] of the positions of x[position, window] but the first and last `skip`."""
        h, (t, n) = self.hidden, x.shape
        table, U, O = self.table(), self.p["U"], self.p["O"]
        state, g, u, d = np.zeros((2, h, n), np.float32), np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32), np.empty((2, h, n), np.float32)
        core = t - 2 * skip
        out = np.zeros((core, len(self.labels), n), np.float32)
        for i in range(t - skip):
            np.take(table[0], x[i], axis=1, out=g[0], mode="clip")
            np.take(table[1], x[t - 1 - i], axis=1, out=g[1], mode="clip")
            np.matmul(U, state, out=u)
            gates, c = g[:, : 2 * h], g[:, 2 * h :]
            gates += u[:, : 2 * h]
            np.clip(gates, 0, 1, out=gates)
            np.multiply(gates[:, h:], u[:, 2 * h :], out=d)
            c += d
            np.tanh(c, out=c)
            c -= state
            c *= gates[:, :h]
            state += c
            if i >= skip:
                y = O @ state
                out[i - skip] += y[0]
                out[core - 1 - (i - skip)] += y[1]
        out += self.p["c"]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions of windows x[position, window] (byte 0: none) with labels y, and its gradients through time."""
        p, h, (t, n) = self.p, self.hidden, x.shape
        table, U, O = self.table(), p["U"], p["O"]
        both = np.stack([x, x[::-1]], 1)  # [step, direction, window]
        states, kept = np.zeros((t + 1, 2, h, n), np.float32), []
        for i in range(t):
            u = U @ states[i]
            g = np.stack([table[0][:, both[i, 0]], table[1][:, both[i, 1]]])
            zr = np.clip(g[:, : 2 * h] + u[:, : 2 * h], 0, 1)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
            states[i + 1] = states[i] + z * (c - states[i])
            kept.append((u[:, 2 * h :], zr, c))
        f, b = states[1:, 0], states[:0:-1, 1]  # by position
        s = O[0] @ f + O[1] @ b + p["c"]
        s -= s.max(1, keepdims=True)
        e = np.exp(s)
        q = e / e.sum(1, keepdims=True)
        w = (x > 0).astype(np.float32)[:, None, :]
        total, at = max(float(w.sum()), 1.0), np.arange(n)
        loss = -float((np.log(q[:, y, at] + 1e-12) * w[:, 0]).sum()) / total
        q[:, y, at] -= 1
        ds = q * w / total
        g = {"O": np.stack([np.einsum("tkn,thn->kh", ds, v, optimize=True) for v in (f, b)]), "c": ds.sum((0, 2))[:, None]}
        back = np.stack([O[0].T @ ds, (O[1].T @ ds)[::-1]], 1)  # by step
        carry, dU, da = np.zeros((2, h, n), np.float32), np.zeros_like(U), np.zeros((t, 2, 3 * h, n), np.float32)
        for i in range(t - 1, -1, -1):
            uc, zr, c = kept[i]
            z, r, before = zr[:, :h], zr[:, h:], states[i]
            dh = carry + back[i]
            dc = dh * z * (1 - c * c)
            live = (zr > 0) & (zr < 1)
            da[i, :, :h], da[i, :, h : 2 * h], da[i, :, 2 * h :] = dh * (c - before) * live[:, :h], dc * uc * live[:, h:], dc
            du = da[i].copy()
            du[:, 2 * h :] *= r
            dU += du @ before.transpose(0, 2, 1)
            carry = dh * (1 - z) + U.transpose(0, 2, 1) @ du
        dtable = np.zeros((2, 3 * h, 256), np.float32)
        for k in range(2):
            seen = both[:, k].ravel()
            order = np.argsort(seen, kind="stable")
            first = np.flatnonzero(np.diff(seen[order].astype(np.int64), prepend=-1))
            dtable[k][:, seen[order][first]] = np.add.reduceat(da[:, k].transpose(1, 0, 2).reshape(3 * h, -1)[:, order], first, axis=1)
        dtable[:, :, 0] = 0
        g |= {"U": dU, "W": dtable @ p["E"], "a": dtable.sum(2, keepdims=True), "E": (dtable.transpose(0, 2, 1) @ p["W"]).sum(0)}
        return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], most: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values())))
        scale = min(1.0, most / (norm + 1e-12))
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def stretches(texts: list[bytes], core: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of the texts with zeros around each, and of every window: its begin in the buffer (margin included), positions and text."""
    n = np.array([len(t) for t in texts], np.int64)
    gap = bytes(core + 2 * margin)
    buffer = np.frombuffer(bytes(margin) + gap.join(texts) + gap, np.uint8)
    begin = np.cumsum(n + len(gap)) - (n + len(gap))
    windows = -(-n // core)
    of = np.repeat(np.arange(len(n)), windows)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * core
    return buffer, begin[of] + at, np.minimum(core, n[of] - at), of


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS, batch: int = BATCH, length: int = LENGTH, rate: float = 0.02, seed: int = 7) -> BiGru:
    """The network for texts and their languages."""
    names = sorted(set(labels))
    model, index, rng = BiGru(names, seed=seed), {k: i for i, k in enumerate(names)}, np.random.default_rng(seed)
    buffer, begin, size, of = stretches(texts, length, 0)
    y = np.array([index[k] for k in labels])[of]
    order = np.argsort(y, kind="stable")
    first = np.searchsorted(y[order], np.arange(len(names) + 1))
    some = np.flatnonzero(np.diff(first))  # languages whose texts have any byte
    adam = Adam(model.p, rate)
    for step in range(steps if len(some) else 0):
        adam.rate = rate * 0.5 ** (4 * step / steps)
        k = some[rng.integers(0, len(some), batch)]
        w = order[first[k] + (rng.random(batch) * (first[k + 1] - first[k])).astype(np.int64)]
        x = buffer[begin[w][:, None] + np.arange(length)].T
        adam.step(model.gradients(np.ascontiguousarray(x), y[w])[1], most=1.0)
    return model


def mean_logs(model: BiGru, texts: list[bytes]) -> np.ndarray:
    """Mean log probability by language over all positions of each text (0 where there are none)."""
    out = np.zeros((len(texts), len(model.labels)))
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (size < GROUP or end == begin):
            size += len(texts[end])
            end += 1
        some = [t.lower() for t in texts[begin:end]]
        buffer, at, n, of = stretches(some, CORE, MARGIN)
        order = np.argsort(-n, kind="stable")  # windows of one length together
        for i in range(0, len(order), TOGETHER):
            w = order[i : i + TOGETHER]
            core = int(n[w].max())
            s = model.logits(np.ascontiguousarray(buffer[at[w][:, None] + np.arange(core + 2 * MARGIN)].T), MARGIN)
            s -= np.log(np.exp(s).sum(1, keepdims=True))
            if n[w[-1]] < core:
                s *= (np.arange(core)[:, None] < n[w])[:, None, :]
            total = s.sum(0, dtype=np.float64)
            for k in range(len(model.labels)):
                out[begin:end, k] += np.bincount(of[w], total[k], len(some))
        out[begin:end] /= np.maximum(1, [len(t) for t in some])[:, None]
        begin = end
    return out


def training_texts(docs: DataFrame, train: Column, sample: int, most: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """(lang, text) of a sample of the labelled documents: of each language at most about `sample` rows, and as many as hold about `most` bytes."""
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    least = F.lit(0)
    for r in sizes:
        least = F.when(F.col("lang") == r["lang"], int(GRAIN * min(1.0, sample / r["n"], most / max(1, r["bytes"])))).otherwise(least)
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(GRAIN)) < least).select("lang", "text").toArrow()
    return sorted(zip(chosen.column("lang").to_pylist(), (t.lower() for c in chosen.column("text").chunks for t in text_bytes(c))))


def train(docs: DataFrame, train: Column, sample: int = SAMPLE, most: int = BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> BiGru | None:
    """The network fitted to a bounded sample of the labelled rows that `train` admits; None if there are none."""
    found = training_texts(docs, train, sample, most, id_col, text_col, lang_col)
    return fit([t for _, t in found], [k for k, _ in found], **how) if found else None


def _verdicts(model: BiGru, texts: list[bytes]) -> tuple[list[str], list[float]]:
    logs = mean_logs(model, texts)
    q = np.exp(logs - logs.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    und = [not any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
    return ["und" if u else model.labels[b] for u, b in zip(und, q.argmax(1))], [0.0 if u else float(p) for u, p in zip(und, q.max(1))]


def predict(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score. The model is a few thousand numbers and travels with the function."""
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return docs.select(F.col(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score = _verdicts(model, text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def keep(docs: DataFrame, model: BiGru | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text has a learned language with a score of at least `least`; none without a model."""
    if model is None:
        return docs.limit(0)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score = _verdicts(model, text_bytes(batch.column(at)))
                yield batch.take(pa.array([i for i, (k, p) in enumerate(zip(lang, score)) if k != "und" and p >= least], pa.int64()))

    return docs.mapInArrow(run, docs.schema)
