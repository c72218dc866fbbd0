"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and each method against a plain version."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, langid, near_dup, packing, quality_mil, quality_rules, toxicity_fm, warc
from tessera.llm.common import Scratch
from tessera.llm.queries import vocabulary

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and it was good " * 4, "en"), (2, None, None), (3, "", "en"), (4, " \t\n", "fr"), (5, LONG, "en"), (None, "the cat sat on the mat", "en"), (7, "x" * 70_000, None),
    (1, "the cat sat on the mat and it was good " * 4, "en"), (9, "один два <|endoftext|> 三  é́ ½ 'S'll \x1c!\x1d?", "ru"), (10, "Le chat est dans la maison et il dort.\nLe chat est dans la maison et il dort.", "fr"), (11, "one", "en"),
]
EXTRA = ", ".join(f"{c} string" for c in ("t", "w", "n", "id", "score", "block", "digest", "sig", "length", "key"))


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return df.withColumns({c.split()[0]: F.lit("clash") for c in EXTRA.split(", ")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (10, 0, 1), (None, 1, 1), (3, None, None), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_rules(odd, none):
    got = odd.transform(quality_rules.apply_rules)
    rows = by_id(got)
    assert got.count() == len(ROWS) and quality_rules.apply_rules(none).count() == 0
    assert (rows[2]["n_words"], rows[2]["kept"], rows[4]["n_words"], rows[5]["n_words"]) == (0, False, 0, 30_000)
    assert rows[1]["n_repeat_words"] == 40 and rows[10]["n_dup_lines"] == 1 and rows[7]["word_chars"] == 70_000


def test_bpe(odd, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = bpe.encode(odd, path)
    for r, (_, text, _) in zip(got.collect(), ROWS):
        assert list(r["ids"] or []) == t.encode(text or "", add_special_tokens=False).ids
    assert bpe.encode(none, path).count() == 0
    c = bpe.codec(path)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdeé ñ th\n'ing12.?!　\x85") for _ in range(rng.randrange(40)))
        ids = np.frombuffer(c.encode(text), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids and c.decode(c.encode(text)) == text


def test_bpe_classes():
    """Plain code points fall into the same pieces as with the library."""
    c = bpe.codec(vocabulary("byte_bpe_50k.json"))
    c.pieces("三")
    for x in [*range(0x240), *range(0x2000, 0x2070), *range(0x20A0, 0x20B0)]:
        for text in (f"a{chr(x)}b", f" {chr(x)}1", f"{chr(x)}{chr(x)} !"):
            assert c.pieces(text) == [text[a:b] for _, (a, b) in c.library.pre_tokenize_str(text)], hex(x)


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), packing.ChunkIds(path)
    texts = [x or "" for _, x, _ in ROWS] + ["It's HE'LL ª²½ <|startoftext|>x <| a|b _-_ don't!!"]
    for text, ids in zip(texts, c.texts([x.encode() for x in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]
    got = packing.pack_documents(odd, path)
    assert packing.pack_documents(none, path).count() == 0
    sequences = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in sequences) <= 2048 and got.where("doc_id = 1").count() == 2 and got.where("doc_id = 2").head()["doc_tokens"] == 1


def test_pack_block():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 100, 500)
    loss = (tokens * rng.random(500)).astype(int)
    limits = packing.Limits(300, 6, 120)
    s, o = packing.pack_block(tokens, loss, limits)
    for k in range(s.max() + 1):
        at = s == k
        assert tokens[at].sum() <= 300 and at.sum() <= 6 and loss[at].sum() <= 120
        assert sorted(zip(o[at], tokens[at]))[0][0] == 0 and set(o[at]) == {0, *np.cumsum([n for _, n in sorted(zip(o[at], tokens[at]))])[:-1].tolist()}
    assert (np.bincount(s) > 0).all()
    with pytest.raises(ValueError):
        packing.pack_block(np.array([301]), np.array([0]), limits)


@pytest.mark.parametrize("seed", range(4))
def test_pack_block_is_the_dot_product_rule(seed):
    """Against a plain version that looks at every example for every pick; all three limits end some sequence."""
    rng = random.Random(seed)
    limits = packing.Limits(100, 5, 60)
    examples = [(n := rng.choice([3, 5, 8, 20, 45, 60]), min(n, rng.choice([0, n // 2, n]))) for _ in range(150)]
    left, filled, room, ended = [*sorted(examples)], [], None, set()
    fits = lambda e, room: e[0] <= room[0] and room[1] >= 1 and e[1] <= room[2]
    while left:
        able = [e for e in left if room and fits(e, room)]
        if not able:
            if room:
                ended |= {k for k in range(3) if any(not fits(e, room) and (e[0], 1, e[1])[k] > room[k] for e in left)}
            room, able = [100, 5, 60], left
            filled.append([])
        dot = lambda e: e[0] / 100 * (room[0] / 100) + 1 / 5 * (room[1] / 5) + e[1] / 60 * (room[2] / 60)  # noqa: E731, B023
        most = max(dot(e) for e in able)
        e = min(x for x in able if dot(x) > most - 1e-12)
        left.remove(e)
        filled[-1].append(e)
        room = [room[0] - e[0], room[1] - 1, room[2] - e[1]]
    s, o = packing.pack_block(*np.array(examples).T, limits)
    got = [[] for _ in filled]
    for k, at, e in sorted(zip(s.tolist(), o.tolist(), examples)):
        got[k].append(e)
    assert got == filled and ended == {0, 1, 2}


@pytest.mark.parametrize("n", [1, 7, 2048, 2049, 2267, 2268, 2269, 4096, 16_384, 100_001])
@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(2048, 32, 2048), packing.Limits(64, 4, 50)])
def test_cuts(n, limits):
    """Every id lies in one piece, every piece fits a sequence, and all but the prompt bears loss."""
    found = sorted(packing.cuts(n, limits))
    assert [a for a, _, _ in found] == [0, *np.cumsum([m for _, m, _ in found])[:-1].tolist()] and sum(m for _, m, _ in found) == n
    assert all(m <= limits.tokens and b <= min(m, limits.loss) for _, m, b in found) and sum(b for _, _, b in found) == n - n // packing.PROMPT


def test_packing_limits_bind(spark):
    """Long documents, short ones and single words: the limits on loss and on segments are met exactly somewhere, and little is padded."""
    path = vocabulary("word_bpe_49k.json")
    texts = ["word " * 9000] * 12 + ["a b"] * 4000 + ["some more words " * 40] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = packing.pack_documents(df, path).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("m"), F.sum("loss_tokens").alias("l")).collect()
    limits = packing.Limits()
    assert all(r["n"] <= limits.tokens and r["m"] <= limits.segments and r["l"] <= limits.loss for r in got)
    assert any(r["l"] == limits.loss for r in got) and any(r["m"] == limits.segments for r in got)


def test_near_dup(spark, odd, none):
    got = by_id(near_dup.classes(spark, odd))
    assert got[2]["component_id"] == 2 and got[3]["kept"] and got[4]["n_shingles"] == 0 and got[None]["kept"] and got[None]["component_id"] is None and got[11]["n_shingles"] == 1
    assert near_dup.classes(spark, odd).count() == len(ROWS) and near_dup.classes(spark, none).count() == 0
    rng = random.Random(5)
    base = [[f"v{rng.randrange(3000)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for i in range(240):  # chains: each a few edits away from an earlier one of its family
        w = list(rng.choice(texts)) if texts and rng.random() < 0.7 else list(rng.choice(base))
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(w)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.classes(spark, df).collect()} == dict(enumerate(root))
    assert len(set(root)) > 6


def test_bayes_bounds():
    t = near_dup.Threshold()
    m = t.least_matches()
    assert (np.diff(m) >= 0).all() and m[-1] < 0.75 * near_dup.MINIMA


def test_fingerprints(spark, odd, none):
    got = fingerprints.edit_and_compare(odd)
    rows = by_id(got)
    assert got.count() == len(ROWS) and fingerprints.edit_and_compare(none).count() == 0
    assert rows[2]["fingerprint"] == "" == rows[3]["fingerprint"] and rows[2]["near_next"] == 1.0 and rows[3]["near_next"] == 1.0 and rows[4]["near_next"] == 0.0
    assert len({r["fingerprint"] for r in got.where("doc_id = 1").collect()}) == 1
    alone = by_id(fingerprints.edit_and_compare(odd.where("doc_id = 10")))[10]
    assert alone["near_next"] == 1.0


def test_ranges(spark):
    """Successors across many ranges, with gaps and repeated ids."""
    ids = sorted(random.Random(2).sample(range(10**12), 3000)) + [10**12] * 3
    df = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(7)
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(df, ["text"]).collect()}
    n = len(ids)
    order = sorted(range(n), key=lambda k: (ids[k], str(k)))
    assert got == {str(a): str(b) for a, b in zip(order, order[1:] + order[:1])}


def test_language(odd, none):
    model = langid.train(odd, F.lit(True), steps=60, batch=32)
    got = by_id(langid.predict(odd, model))
    assert got[2]["lang_pred"] == got[4]["lang_pred"] == "und" and got[2]["score"] == 0.0 and set(model.labels) == {"en", "fr", "ru"}
    assert got[9]["lang_pred"] == "ru"
    assert langid.train(none, F.lit(True)) is None and langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.keep(odd, model, 0.0).columns == odd.columns and langid.keep(odd, None, 0.0).count() == 0


def test_letters():
    """Numbers that are no letters make no language."""
    model = langid.BiGru(["a", "b"])
    assert langid._verdicts(model, [x.encode() for x in ("½ ² ①", "12 !?", "", "é", "12 三")])[0].count("und") == 3


def plain_logs(m, text: bytes) -> np.ndarray:
    """Mean log probability of a text, a position and a number at a time, each direction from MARGIN bytes before the position's window."""
    h, E, total = m.hidden, m.p["E"], np.zeros(len(m.labels))
    text = text.lower()

    def step(d, byte, state):
        if not byte:
            return state
        g = m.p["W"][d] @ E[byte] + m.p["a"][d][:, 0]
        u = m.p["U"][d] @ state
        z, r = (np.clip(g[k : k + h] + u[k : k + h] + 0.5, 0, 1) for k in (0, h))
        return state + z * (np.tanh(g[2 * h :] + r * u[2 * h :]) - state)

    for a in range(0, len(text), langid.CORE):
        b, states = min(a + langid.CORE, len(text)), {}
        state = np.zeros(h)
        for i in range(max(0, a - langid.MARGIN), b):
            states[i] = [state := step(0, text[i], state)]
        state = np.zeros(h)
        for i in range(min(len(text), b + langid.MARGIN) - 1, a - 1, -1):
            state = step(1, text[i], state)
            states.setdefault(i, []).append(state)
        for i in range(a, b):
            s = m.p["O"][0] @ states[i][0] + m.p["O"][1] @ states[i][1] + m.p["c"][:, 0]
            total += s - np.log(np.exp(s).sum())
    return total / max(1, len(text))


def test_language_by_position():
    """Windows run together against a plain version, for texts around the window's length, without blanks and with byte 0."""
    rng = random.Random(4)
    m = langid.fit([b"the cat is on the mat and it was good " * 30, b"le chat est dans la maison et il dort " * 30], ["en", "fr"], steps=20, batch=16)
    texts = [bytes(rng.choice(b"abcdefgh thelecats\xc3\xa9.") for _ in range(n)) for n in (0, 1, 15, 16, 17, langid.CORE - 1, langid.CORE, langid.CORE + 1, 3 * langid.CORE + 5, 2000)] + [b"x" * 700, b"a\0b" * 60]
    got = langid.mean_logs(m, texts)
    for t, g in zip(texts, got):
        assert g == pytest.approx(plain_logs(m, t), abs=2e-4), len(t)


def test_language_state_crosses_blanks():
    """What a position says depends on the words around its own."""
    m = langid.fit([b"the cat is on the mat and it was good " * 30, b"le chat est dans la maison et il dort " * 30], ["en", "fr"], steps=60, batch=32)
    x = np.frombuffer(b"the on was" + b"le est dort"[:10], np.uint8).reshape(2, 10).T
    one, two = (m.logits(np.ascontiguousarray(np.concatenate([x, np.tile(np.frombuffer(b" on", np.uint8)[:, None], 2)])))[-1, :, k] for k in (0, 1))
    assert np.abs(one - two).max() > 0.05


def test_language_windows_forget():
    """The margin is long enough: a window's positions say nearly what they say when the whole text is one window."""
    rng = random.Random(2)
    en, fr = "the cat is on mat and it was good".split(), "le chat est dans la maison et il dort".split()
    texts = [" ".join(rng.choice(w) for _ in range(400)).encode() for w in (en, fr) for _ in range(4)]
    m = langid.fit(texts, ["en"] * 4 + ["fr"] * 4, steps=100, batch=64)
    windows = langid.mean_logs(m, texts)
    for t, got in zip(texts, windows):
        s = m.logits(np.frombuffer(t, np.uint8)[:, None])
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        assert got == pytest.approx(s.mean(0)[:, 0], rel=0.05, abs=0.02)


def test_language_gradients():
    """Backpropagation through time against differences."""
    m = langid.BiGru(["a", "b", "c"], hidden=5, embed=4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = np.zeros((5, 3), np.uint8)
    for k, t in enumerate((b"abc", b"xy", b"hello")):
        x[: len(t), k] = list(t)
    y = np.array([0, 1, 2])
    _, g = m.gradients(x, y)
    rng = np.random.default_rng(0)
    for k, p in m.p.items():
        for _ in range(6):
            at = (int(rng.choice(list(b"abcxyhelo"))), int(rng.integers(p.shape[1]))) if k == "E" else tuple(int(rng.integers(s)) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-3
            up = m.gradients(x, y)[0]
            p[at] = old - 1e-3
            down = m.gradients(x, y)[0]
            p[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=3e-2, abs=3e-4), k


def test_rare_languages_are_sampled_whole(spark):
    """Of a language with few rows all are taken, whatever the others have."""
    rows = [(i, f"common text {i}", "en") for i in range(3000)] + [(5000 + i, f"sjeldan tekst {i}", "nn") for i in range(3)]
    found = langid.training_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), 200, 10**6, "doc_id", "text", "lang")
    n = [k for k, _ in found]
    assert n.count("nn") == 3 and 120 < n.count("en") < 280


def test_quality(odd, none, labels):
    model = quality_mil.train(odd, labels, F.lit(True), epochs=2)
    got = quality_mil.score(odd, model)
    assert got.count() == len(ROWS) and got.where("score is null or score < 0 or score > 1").count() == 0 and quality_mil.score(none, model).count() == 0
    assert quality_mil.train(none, labels, F.lit(True)) is None and quality_mil.score(odd, None).where("score <> 0.5").count() == 0


def test_quality_gradients():
    m = quality_mil.GatedAttention()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(3)
    x, first, y = rng.standard_normal((7, quality_mil.SIZE)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := m.score(x, first), 1 - p)))
    g = m.gradients(x, first, y, 0.0)
    for k in g:
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in m.p[k].shape)
            old = m.p[k][at]
            m.p[k][at] = old + 1e-6
            up = loss()
            m.p[k][at] = old - 1e-6
            down = loss()
            m.p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7), k


def test_attention_finds_the_passage():
    """Bags whose label hangs on one of their passages."""
    rng = np.random.default_rng(9)
    bags, y = [], []
    for k in range(1300):
        b = rng.standard_normal((int(rng.integers(1, 9)), quality_mil.SIZE)).astype(np.float32)
        if k % 2:
            b[int(rng.integers(len(b))), 3] += 6
        bags.append(b)
        y.append(k % 2)
    m = quality_mil.fit(bags[:1000], np.array(y[:1000]), epochs=20)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags[1000:]])])
    assert np.mean((m.score(np.concatenate(bags[1000:]), first) > 0.5) == np.array(y[1000:])) > 0.9


def test_toxicity(odd, none, labels):
    model = toxicity_fm.train(odd, labels, F.lit(True), epochs=2)
    got = toxicity_fm.score(odd, model)
    assert got.count() == len(ROWS) and got.where("score is null").count() == 0 and toxicity_fm.score(none, model).count() == 0
    assert toxicity_fm.train(none, labels, F.lit(True)) is None and toxicity_fm.score(odd, None).where("score <> 0").count() == 0


def test_pairs_are_learnt():
    """Two harmless terms that are toxic together, which no additive weights can tell."""
    rng = np.random.default_rng(4)
    docs, y = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        docs.append(sorted([*(100 * a, 200 * b), *(1000 + 2 * rng.integers(0, 30, 4))]))
        y.append(0)
    docs, y = [sorted({int(t) for t in d if t}) for d in docs], np.array(y)
    flat = lambda ds: (np.repeat(np.arange(len(ds)), [len(d) for d in ds]), np.array([t for d in ds for t in d], np.int64))
    y = np.array([int((100 in d) == (200 in d)) for d in docs])  # equality: its linear part is nil
    doc, term = flat(docs[:900])
    m = toxicity_fm.fit(doc, term, np.ones(len(term)), y[:900])
    doc, term = flat(docs[900:])
    row = m.rows(term) >> 1
    assert np.mean((m.logits(doc[row > 0], row[row > 0], np.ones((row > 0).sum()), 300) > 0) == y[900:]) > 0.95


def test_pairs_are_learnt_from_texts(spark):
    """The same through train(), among many chance words that tell more alone."""
    rng = np.random.default_rng(8)
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join([*(f"{k}q" for k in rng.integers(100, 1100, 6)), *["alpha"] * int(a), *["omega"] * int(b)]))
        y.append(int(a == b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = toxicity_fm.train(docs, spark.createDataFrame(list(enumerate(y)), "doc_id bigint, toxic int"), F.col("doc_id") < 1200)
    got = by_id(toxicity_fm.score(docs.where("doc_id >= 1200"), model))
    assert np.mean([(r["score"] > 0.5) == y[i] for i, r in got.items()]) > 0.9


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a/é\r\nx", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "u", None), (4, "u", ""), (5, "u", "é" * 5000), (None, "u", "<p>one</p>"), (5, "u", "é" * 5000)], "page_id bigint, url string, html string").withColumn("d", F.lit("clash"))
    got = warc.round_trip(spark, pages).collect()
    rows = {r["page_id"]: r for r in got}
    assert len(got) == 7 and rows[None]["record_type"] == "response" and rows[1]["record_type"] == "revisit" and rows[4]["refers_to"] == 2 and rows[3]["payload_bytes"] == 10 and rows[5]["payload_bytes"] == 10_000
    assert rows[3]["url"] == "http://a/é\r\nx" and rows[5]["record_type"] == "response"
    scratch = Scratch(spark, "w")
    index = warc.write(pages, scratch, least=11)
    some = warc.read(index.where("page_id in (2, 5)"), scratch.root, stretch=100)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in some.collect()) == [(2, b"")] + [(5, ("é" * 5000).encode())] * 2
    assert index.where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(spark, pages.where("false")).count() == 0
