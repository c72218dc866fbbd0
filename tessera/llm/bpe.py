"""Byte-level BPE, encoded by dynamic programming over prefixes and decoded again.

For every prefix of a piece of text there is exactly one token that BPE can put last there. A suffix automaton (the vocabulary's trie
with suffix links) lists the tokens that end at a place; a candidate is the last token if it goes with the last token of the prefix
before it, which a walk up the two tokens' merge trees decides. Back-pointers from the end then give the ids. No merge loop and
no tokenizer library is involved in encoding.

Whole texts are encoded; null and empty texts have no ids. A text is cut into pieces at the byte-level pattern; each distinct
piece is encoded once per worker and kept in a bounded memory. New pieces are encoded in sorted order, so that the prefixes they
share are walked once. Rows are independent: repeated rows repeat their result, extra columns are never read, an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public byte-level pattern (contractions, letters, digits, the rest, blanks).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose classes are the same in every Unicode version in use; a text with others is cut by the library's own pre-tokenizer.
PLAIN = r"[\u0000-\u0240\u2000-\u206f\u20a0-\u20b0]*"
NEVER = 1 << 60
MEMORY = 400_000
#: Bytes of text whose new pieces are encoded together.
GROUP = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BytePairCodec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        alphabet, model = byte_alphabet(), told["model"]
        self.path = path
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.raw: dict[int, bytes] = {}
        for token, i in model["vocab"].items():
            self.raw[i] = bytes(alphabet[c] for c in token)
        self.raw.update({i: s.encode() for s, i in self.special.items()})
        #: (left, right) -> rank of the merge; token -> (left, right, rank) it is made by
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a_id, b_id, ab = vocab[a], vocab[b], vocab[a + b]
            self.ranks[a_id, b_id] = rank
            self.made.setdefault(ab, (a_id, b_id, rank))
        self.right, self.left = {}, {}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self._build({b: i for i, b in self.raw.items() if i not in self.special.values()})
        self.pattern, self.plain = regex.compile(PATTERN), regex.compile(PLAIN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.library = None
        self.memory: dict[str, bytes] = {}

    # --- suffix automaton ---------------------------------------------------------------------------------------------------
    def _build(self, tokens: dict[bytes, int]) -> None:
        """Trie of the tokens, its suffix links, and for every state the tokens that end there, longest first. Links into the trie are made moves as they are met."""
        self.move: dict[int, int] = {}
        self.ending: list[tuple] = [()]
        for b, token in tokens.items():
            state = 0
            for x in b:
                to = self.move.get(state << 8 | x)
                if to is None:
                    to = self.move[state << 8 | x] = len(self.ending)
                    self.ending.append(())
                state = to
            if self.stands(token):
                self.ending[state] = ((token, len(b)),)
        self.link = [0] * len(self.ending)
        below: list[list[tuple[int, int]]] = [[] for _ in self.ending]
        for key, to in self.move.items():
            below[key >> 8].append((key & 255, to))
        todo = deque([0])
        while todo:
            state = todo.popleft()
            for x, to in below[state]:
                if state:
                    at = self.link[state]
                    while at and at << 8 | x not in self.move:
                        at = self.link[at]
                    self.link[to] = self.move.get(at << 8 | x, 0)
                    self.ending[to] += self.ending[self.link[to]]
                todo.append(to)

    def _step(self, state: int, x: int) -> int:
        at = state
        while at and at << 8 | x not in self.move:
            at = self.link[at]
        to = self.move.get(at << 8 | x, 0)
        if at != state and len(self.move) < 3_000_000:
            self.move[state << 8 | x] = to
        return to

    # --- pair compatibility -------------------------------------------------------------------------------------------------
    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along one outer edge of a merge tree, byte first, each with the rank of the merge that takes it up."""
        known = self.left if side == 0 else self.right
        if (found := known.get(token)) is None:
            chain, up, t = [], NEVER, token
            while True:
                chain.append((t, up))
                if t not in self.made:
                    break
                up = self.made[t][2]
                t = self.made[t][side]
            known[token] = found = chain[::-1]
        return found

    def _meets(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair across the border of a|b that BPE would merge, in the order in which merges come; None if it never does."""
        x, y, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (s, up_s), (t, up_t) = x[i], y[j]
            across = self.ranks.get((s, t), NEVER)
            # Of equal pairs the leftmost merges first: that is the left token's own merge before the border's, the border's before the right token's.
            if across < up_s and across <= up_t and across < NEVER:
                return s, t
            if up_s >= NEVER and up_t >= NEVER:
                return None
            if up_s <= up_t:
                i += 1
            else:
                j += 1

    def stands(self, token: int) -> bool:
        """Whether BPE gives this token for its own bytes."""
        if (known := self.alone.get(token)) is None:
            if token not in self.made:
                known = True
            else:
                a, b, _ = self.made[token]
                known = self.stands(a) and self.stands(b) and self._meets(a, b) == (a, b)
            self.alone[token] = known
        return known

    def goes(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            self.pairs[key] = known = self._meets(a, b) is None
        return known

    # --- encoding -----------------------------------------------------------------------------------------------------------
    def encode_sorted(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each piece; last[i] is the only token that can end the prefix of i bytes. Sorted pieces share their prefixes' work."""
        states, last, length = [0], [-1], [0]
        move, ending, pairs = self.move, self.ending, self.pairs
        before = b""
        for piece in pieces:
            n, same = len(piece), 0
            most = min(n, len(before))
            while same < most and piece[same] == before[same]:
                same += 1
            del states[same + 1 :], last[same + 1 :], length[same + 1 :]
            state = states[same]
            for i in range(same, n):
                to = move.get(state << 8 | piece[i])
                state = self._step(state, piece[i]) if to is None else to
                for token, size in ending[state]:
                    if size == i + 1:
                        break
                    prior = last[i + 1 - size]
                    goes = pairs.get(prior << 32 | token)
                    if self.goes(prior, token) if goes is None else goes:
                        break
                else:
                    raise ValueError("the vocabulary has no token for some byte")
                states.append(state)
                last.append(token)
                length.append(size)
            out, at = [], n
            while at:
                out.append(last[at])
                at -= length[at]
            before = piece
            yield array("I", out[::-1]).tobytes()

    def encode_piece(self, piece: bytes) -> list[int]:
        return np.frombuffer(next(self.encode_sorted([piece])), "<u4").tolist()

    def pieces(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """Pieces of a whole text; special strings are pieces of their own."""
        if self.cut and "<" in text:
            return [p for part in self.cut.split(text) for p in ((part,) if part in self.special else self.pieces(part))]
        return self.pieces(text)

    def learn(self, new: set[str]) -> None:
        for s in new & self.special.keys():
            self.memory[s] = self.special[s].to_bytes(4, "little")
        found = sorted((p.encode("utf-8", "replace"), p) for p in new - self.special.keys())
        self.memory.update(zip((p for _, p in found), self.encode_sorted([b for b, _ in found])))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        begin = 0
        while begin < len(texts):
            end = begin
            size = 0
            while end < len(texts) and (size < GROUP or end == begin):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[begin:end]]
            distinct = set().union(*split)
            if new := distinct - self.memory.keys():
                if len(self.memory) + len(new) > MEMORY:
                    self.memory.clear()
                    new = distinct
                if len(self.pairs) > 1_000_000:
                    self.pairs.clear()
                self.learn(new)
            for s in split:
                yield b"".join(map(self.memory.__getitem__, s))
            begin = end

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    # --- decoding -----------------------------------------------------------------------------------------------------------
    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec per worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: id, n_tokens, `ids` (array<int>, if wanted), sha256 of the packed ids and of the text decoded from them."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, a, b, ids = [], [], [], []
            for packed in c.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(c.decode(packed).encode()).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
