"""What needs no Spark: codecs, indices, models."""

import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm import bitplanes, bpe, fmindex, neardup, pii, substrings, toxicity, webp
from linkloom.llm.common import vocabulary_path, word_hashes, word_spans

PATH = vocabulary_path()
LIB = Tokenizer.from_file(PATH)
ODD = ["", "ΑΣ ΣΑΣ İx \x1c a\x1db\x85c <|endoftext|>Hello <|startoftext|> <|x", "é ́a I'LL don't 12ab²", "   ", "a" * 3000, "​﻿x", "ÄÖ½ǅ, the. Word, word.", "...,,, a.,", "x y　z"]


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24FF, exclude_categories=("Cs", "Cn")), max_size=60))  # letters newer than the library's Unicode tables differ
def test_bpe_is_the_library(text):
    model = bpe.bpe(PATH)
    want = LIB.encode(text, add_special_tokens=False).ids
    assert model.encode(text) == want
    assert model.rendered(text) == (len(want), " ".join(map(str, want)), LIB.decode(want, skip_special_tokens=False))


@pytest.mark.parametrize("text", ODD)
def test_bpe_odd_texts(text):
    test_bpe_is_the_library.hypothesis.inner_test(text)


def test_word_encoder_is_the_library():
    enc = bitplanes.WordEncoder(PATH)
    texts = [*ODD, None, "the the. The, the", "the word"] * 2
    want = [np.array(LIB.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert enc.encode(texts) == want and enc.encode(texts) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=8), st.integers(1, 50))
def test_bitplane_files(docs, chunk):
    old, bitplanes.CHUNK = bitplanes.CHUNK, chunk
    try:
        f = io.BytesIO()
        bitplanes.write_file(f, ((k, np.array(d, np.uint32)) for k, d in enumerate(docs)))
    finally:
        bitplanes.CHUNK = old
    got = {k: ids.tolist() for e in bitplanes.read_index(f, f.tell()) for k, ids in bitplanes.read_chunk(f, e)}
    assert got == dict(enumerate(docs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_all(docs, patterns):
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    words = np.array([w for d in docs for w in d], np.uint64) * np.uint64(1 << 40)
    index = fmindex.FMIndex(words, first)
    rows = np.zeros((len(patterns), 4), np.uint64)
    for k, p in enumerate(patterns):
        rows[k, : len(p)] = np.array(p, np.uint64) * np.uint64(1 << 40)
    live, lo, hi = index.search(rows, np.array([len(p) for p in patterns]))
    got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(live, lo, hi)}
    for k, p in enumerate(patterns):
        want = [int(first[d]) + s for d, doc in enumerate(docs) for s in range(len(doc) - len(p) + 1) if doc[s : s + len(p)] == p]
        assert got.get(k, []) == want


def test_difference_covers():
    for period, cover in substrings._COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substrings.cover_for(35) == (21, [0, 1, 4, 14, 16])


def test_words_are_runs_within_texts():
    texts = ["ab cd", "", "ef", " g h ", "ij"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, e, first = word_spans(raw, offsets, substrings._IS_WORD)
    words = [raw[a:b].tobytes().decode() for a, b in zip(s, e)]
    assert words == ["ab", "cd", "ef", "g", "h", "ij"] and first.tolist() == [0, 2, 2, 3, 5, 6]
    assert len(set(word_hashes(raw, s, e).tolist())) == 6


@pytest.mark.parametrize("seed", range(6))
def test_webp_round_trips(seed):
    rng = np.random.default_rng(seed)
    h, w = int(rng.integers(1, 40)), int(rng.integers(1, 40))
    kinds = [rng.integers(0, 1 << 32, (h, w)), rng.choice(rng.integers(0, 1 << 32, 3), (h, w)), np.full((h, w), 0xFF102030), rng.integers(0, 256, (h, w)) * 0x01010101]
    blocks = (rng.integers(0, 14, ((h + 3) // 4) * ((w + 3) // 4)) << 8).astype(np.uint32)
    cross = (rng.integers(0, 1 << 24, ((h + 7) // 8) * ((w + 7) // 8)) | 0xFF000000).astype(np.uint32)
    for p in kinds:
        p = p.astype(np.uint32)
        ways = [((), b) for b in (None, 0, 1, 11)] + [((("green",),), 0), ((("predictor", 2, blocks),), 0), ((("cross", 3, cross),), 2), ((("predictor", 2, blocks), ("cross", 3, cross), ("green",)), 3)]
        if len(np.unique(p)) <= 256:
            ways.append(((("palette",),), 0))
        for transforms, bits in ways:
            assert (webp.decode(webp.encode(p, bits, transforms)) == p).all()


def test_webp_of_another_writer():
    # written bit by bit after the format's description: 2 x 1, one code group, simple codes, a literal and a back-reference of one
    w = webp.Writer()
    for v, n in ((1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(v, n)
    for one in (5, 6, 7, 255):  # one symbol each, of 8 bits
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(one, 8)
    w.put(1, 1), w.put(0, 1), w.put(0, 1), w.put(0, 1)
    data = b"\x2f" + w.acc.to_bytes((w.n + 7) // 8, "little")
    data += bytes(len(data) & 1)
    file = b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
    assert webp.decode(file).tolist() == [[0xFF060507, 0xFF060507]]
    for broken in (file[:10], b"x" * 40, file[:20] + b"\x30" + file[21:]):
        with pytest.raises(webp.FormatError):
            webp.decode(broken)


def test_webp_predictors_by_hand():
    assert webp.predict(0, 1, 2, 3, 4) == 0xFF000000 and [webp.predict(k, 1, 2, 3, 4) for k in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert webp.predict(7, 0x10203040, 0x30405060, 0, 0) == 0x20304050
    assert webp.predict(12, 0xFF, 0xFF, 0, 0x10) == 0xFF and webp.predict(11, 10, 20, 0, 10) == 20
    assert webp.predict(13, 10, 10, 0, 13) == 9


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_base(x):
    digits = lambda s: re.sub(r"\D", "", s)
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(x)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a0123459.@+- ()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


def test_semi_crf():
    w = pii.train()
    text = 'so token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and version 3. of 12 or call (017) 555-7713.'
    base, spans = pii.find_spans(text, w)
    assert base == [] and [(text[a:b], k) for a, b, k in spans] == [("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret"), ("(017) 555-7713", "phone")]
    assert pii.mask(text, spans).startswith('so token = "<secret>" and version 3.')
    for clean in ("the year 2021 and 15 of 30, CC BY-NC 4.0.", "nothing here", "", None):
        assert pii.find_spans(clean, w) == ([], [])


def test_entities_of_several_tokens():
    w = pii.train()
    for text, want in (
        ("so mail bob12 [at] site [dot] com now", ("bob12 [at] site [dot] com", "email")),
        ("so mail alice [at] example [dot] org now", ("alice [at] example [dot] org", "email")),
        ("so call 555 - 123 - 4567 now", ("555 - 123 - 4567", "phone")),
    ):
        assert [(text[a:b], k) for a, b, k in pii.find_spans(text, w)[1]] == [want]
    assert pii.find_spans("we met (at) noon and left", w) == ([], [])


def test_semi_markov_sums_by_enumeration():
    rng = np.random.default_rng(2)
    n, segs = 4, [(i, j) for i in range(4) for j in range(i + 1, 5)]
    scores = rng.normal(size=(len(segs), 2))
    total, mass, best = 0.0, np.zeros_like(scores), (-1e9, None)

    def paths(at, chosen, score):
        nonlocal total, best
        if at == n:
            total += np.exp(score)
            for c in chosen:
                mass[c] += np.exp(score)
            best = max(best, (score, chosen))
            return
        paths(at + 1, chosen, score)
        for k, (i, j) in enumerate(segs):
            if i == at:
                for t in range(2):
                    paths(j, [*chosen, (k, t)], score + scores[k, t])

    paths(0, [], 0.0)
    assert np.allclose(pii.marginals(n, segs, scores), mass / total)
    assert pii.best_path(n, segs, scores) == best[1]


def test_string_kernel_by_definition():
    def brute(a, b):
        def vec(s):
            d = {}
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, len(s)):
                        if k - i < toxicity.SPAN:
                            key = s[i] + s[j] + s[k]
                            d[key] = d.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return d

        x, y = vec(a), vec(b)
        dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    marks = ["idiot", "stupid", "worthless"]
    got = toxicity.Landmarks(marks).kernels(["idiot", "idxiot", "stuupid", "worthles", "banana", "idiots"])
    for u, hits in got.items():
        want = {k: brute(u, m) for k, m in enumerate(marks)}
        want = {k: v for k, v in want.items() if v >= toxicity.FLOOR}
        have = dict(zip(hits[0].tolist(), hits[1].tolist())) if hits else {}
        assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-4 for k in want)


def test_toxicity_model_tolerates_gaps():
    rng = random.Random(1)
    words = "the of and river stone market walking yellow quiet paper window garden letter simple north".split()
    bad = ["idiot", "stupid", "moron", "worthless", "pathetic"]
    texts, labels = [], []
    for k in range(400):
        t = [rng.choice(words) for _ in range(30)]
        if k % 4 == 0:
            t[3:3] = rng.sample(bad, 2)
        texts.append(" ".join(t))
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts, labels)
    s = toxicity.text_scores(model, 1, ["you i.d.i.o.t and s t u p i d one", "a st-up-id m0ron here", "a quiet river", "", None, "the mooron is stuupid"])
    assert (s[[0, 1]] > 0.7).all() and (s[[2, 3, 4]] < 0.3).all() and s[5] > s[2]
    assert (toxicity.text_scores(toxicity.Model(None), 0, ["x"]) == 0).all()
    assert toxicity.units_of_word("a" * 40) == ["a" * 16] * 4


def test_jaccard_thresholds_and_tuning():
    assert neardup.jaccard_threshold(1, 10, 10) == 1 and neardup.jaccard_threshold(0.5, 10, 20) == pytest.approx(0.2)
    for s in (0.3, 0.5, 0.8):
        bands, rows = neardup.tune(s)
        assert 1 - (1 - s**rows) ** bands >= neardup.LEAST_CHANCE and bands * rows <= neardup.HASHES
    ends = neardup._ENDS[:40]
    for size in range(1, 200):
        for other in range(size, int(size * neardup.RATIO + 1e-9) + 1):
            assert np.searchsorted(ends, other) - np.searchsorted(ends, size) <= 1


def test_shingles_are_sets():
    rows = pa.table({"text": ["a b c d", "a", "", None, "x y", "b c d b c d"]})
    values, offsets = neardup.shingles(rows)
    assert np.diff(offsets).tolist() == [2, 1, 0, 0, 1, 3]
    assert set(values[0:2].tolist()) & set(values[offsets[5] :].tolist())


def brute_kernel(u, v):
    """The gap-weighted kernel from its definition, normalised."""

    def vector(x):
        out = {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                    key = x[i], x[j], x[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = vector(u), vector(v)
    dot = lambda p, q: sum(w * q.get(key, 0) for key, w in p.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


@pytest.mark.parametrize("marks", [["idiot", "worthless", "stupid"], ["дурак", "идиот", "idiot"], ["".join(map(chr, range(0x4E00 + 9 * k, 0x4E00 + 9 * k + 9))) for k in range(40)]])
def test_scores_from_definitions(marks):
    """Kernels, text features and scores of a model, densely and by definition, in any script."""
    r = random.Random(4)
    words = [*marks, *(m[:2] + "x" + m[2:] for m in marks), *(m[1:] for m in marks), "привет", "земля", "你好世界啊", "hello", "idiocy", "дуракаваляние"]
    bad = toxicity.Landmarks(marks)
    got = bad.kernels(words)
    for w in words:
        want = {k: v for k, m in enumerate(marks) if (v := brute_kernel(w, m)) >= toxicity.FLOOR}
        have = {} if got[w] is None else dict(zip(got[w][0].tolist(), got[w][1].tolist()))
        assert have == pytest.approx(want, abs=1e-5)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(160)]
    labels = [int(any(w in marks for w in t.split())) for t in texts]
    model = toxicity.fit(texts, labels)
    units = model.landmarks.units
    dense = np.zeros((len(texts), len(units)))
    for i, t in enumerate(texts):
        for w in toxicity.words_of(t):
            for u in toxicity.units_of_word(w):
                for k, m in enumerate(units):
                    v = brute_kernel(u, m)
                    if v >= toxicity.FLOOR:
                        dense[i, k] = max(dense[i, k], v)
    features = np.concatenate([dense**p @ m for p, m in zip(toxicity.POWERS, model.maps)], axis=1)
    z = model.scale[0] * (features @ model.weights + model.bias) + model.scale[1]
    assert toxicity.text_scores(model, f"test{marks[0]}", texts) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_only_units_near_a_landmark_are_taken_in_full(monkeypatch):
    """Units of the landmarks' own letters that are like none of them are left by a bound; none that has a kernel is."""
    r = random.Random(6)
    unit = lambda: "".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(6, 14)))
    marks = list(dict.fromkeys(unit() for _ in range(96)))
    bad = toxicity.Landmarks(marks)
    forms = [m[:k] + x + m[k:] for m in marks[::4] for k, x in ((2, ""), (3, "q"), (4, "п"), (len(m), "s"))]
    forms += [m[:2] + m[3:] for m in marks[::4]] + [marks[0] * 2]
    words = list(dict.fromkeys([*forms, *(unit() for _ in range(3000))]))
    full = []
    real = toxicity.subsequence_rows
    monkeypatch.setattr(toxicity, "subsequence_rows", lambda units, *rest: full.extend(units) or real(units, *rest))
    got = bad.kernels(words)
    assert len(full) < len(words) / 4
    for w in [*forms, *r.sample(words, 60)]:
        want = {k: v for k, m in enumerate(marks) if (v := brute_kernel(w, m)) >= toxicity.FLOOR}
        have = {} if got[w] is None else dict(zip(got[w][0].tolist(), got[w][1].tolist()))
        assert have == pytest.approx(want, abs=1e-5)


def test_scorer_forgets_without_a_change(monkeypatch):
    """Features are those of the definition also when the words that are remembered go between batches."""
    r = random.Random(7)
    marks = ["idiot", "worthless", "stupid"]
    words = [*marks, *(m[:2] + "x" + m[2:] for m in marks), "Idiot!!", "m0ron,", "worthless" * 3, *("".join(r.choices("abcdeghilmnorst", k=7)) for _ in range(200)), "3.14", "!!!"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 20))) for _ in range(120)] + [None, ""]
    monkeypatch.setattr(toxicity, "MEMORY_BYTES", 4000)
    scorer = toxicity.Scorer(toxicity.Landmarks(marks))
    got = np.concatenate([scorer.largest(texts[k : k + 10]) for k in range(0, len(texts), 10)])
    assert scorer.old
    for t, row in zip(texts, got):
        kernels = [[brute_kernel(u, m) for m in marks] for w in toxicity.words_of(t) for u in toxicity.units_of_word(w)]
        want = np.max([[v if v >= toxicity.FLOOR else 0 for v in ks] for ks in [*kernels, [0] * len(marks)]], axis=0)
        assert row == pytest.approx(want, abs=1e-5)
    assert [toxicity.units_of_word(w) for w in ("Idiot!!", "m0ron,", "3.14", "!!!", "i.d.i.o.t")] == [["idiot"], ["moron"], [], [], ["idiot"]]
    assert toxicity.Landmarks([]).kernels(["idiot", "ababab"]) == {"idiot": None, "ababab": None}
    assert toxicity.text_scores(toxicity.fit(["12 !", "", "a river"] * 20, [1, 0, 0] * 20), "none", ["idiot", None, "7"]).shape == (3,)


def test_svm_is_at_its_minimum():
    """No step from the solution makes the regularised squared hinge smaller by more than a trace."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x @ rng.normal(size=6) + 0.5 * rng.normal(size=300) > 0.4).astype(np.int64)
    w, b = toxicity.train_svm(x, y)

    def loss(v):
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum()) * 4.0
        return 0.5e-3 * (v[:-1] ** 2).sum() + (share * np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ v[:-1] + v[-1])) ** 2).sum()

    best = np.append(w, b)
    here = loss(best)
    for _ in range(400):
        assert loss(best + rng.normal(size=7) * rng.choice([1e-3, 1e-2, 0.1])) >= here - 1e-5


def test_word_encoder_on_all_code_points():
    """Every assigned code point in several places of a word, against the library."""
    import unicodedata

    enc = bitplanes.WordEncoder(PATH)
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    some = random.Random(1).sample(every, 20_000) + every[:0x3000]
    for make in (lambda c: c, lambda c: c + ".", lambda c: "a" + c + ",", lambda c: "x" + c + "y$$$", lambda c: "'" + c + "s"):
        texts = [make(c) for c in some]
        want = [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(g, enc.kind).tolist() for g in enc.encode(texts)] == want


def test_word_encoder_forgets():
    """A memory smaller than the words that come changes nothing."""
    enc = bitplanes.WordEncoder(PATH)
    enc.words, enc.room = bitplanes.Remembered(enc.kind, 40), 500
    texts = [" ".join(f"w{k}x, {chr(97 + k % 26) * (k % 7 + 1)}." for k in range(s, s + 12)) for s in range(0, 300, 5)] + ["a " * 50]
    for s in range(0, len(texts), 4):
        want = [np.array(LIB.encode(t, add_special_tokens=False).ids, enc.kind).tobytes() for t in texts[s : s + 4]]
        assert enc.encode(texts[s : s + 4]) == want


def test_narrow_values_meet_in_their_bucket():
    from linkloom.llm import blocks

    a = np.array([1 << 63, 5, (1 << 64) - 1, 7 << 40, 5 + (1 << 20)], np.uint64)
    for bits in (0, 3, 24):
        kept = np.sort(blocks.narrow(a, bits))
        batch = blocks.send(9, a, None, bits)
        back = np.concatenate([blocks.unpack(v, False, k)[0] for k, v in zip(batch.column("bucket").to_pylist(), batch.column("vals").to_pylist())])
        assert sorted(set(back.tolist())) == sorted(set(kept.tolist())) and set(batch.column("block").to_pylist()) == {9}


def test_model_alone_decides_on_stretches():
    """The added spans are the best path over the lattice of the whole text, where segments outside stretches are no candidates."""
    w = pii.train()
    r = random.Random(12)
    texts = [t for t, _ in pii.training_sentences(60, 77)] + ["write to report [at] order.com today"]
    texts += [" ".join(r.choice(["12", "a1", "3.5", "(7)", "b@", "x", "and", "2024.", "9,", "1-2", "[4]", "q7!", "100%"]) for _ in range(r.randint(1, 9))) for _ in range(100)]
    for text in texts:
        base, spans = pii.find_spans(text, w)
        units, segs, rows = [], [], []
        for part in pii.stretches(text, [s for s in base]) if not any(a[1] > b[0] for a, b in zip(base, base[1:])) else []:
            n = len(units)
            for i, j in pii.lattice(text, part)[0]:
                segs.append((n + i, n + j))
                rows.append(pii.span_features(text, part[i][0], part[j - 1][1]))
            units += part
        if not segs:
            continue
        x = np.zeros((len(segs), w.shape[0]))
        for k, on in enumerate(rows):
            x[k, on] = 1
        scores = x @ w
        p = pii.marginals(len(units), segs, scores)
        want = {(units[segs[k][0]][0], units[segs[k][1] - 1][1], pii.KINDS[t]) for k, t in pii.best_path(len(units), segs, scores) if p[k, t] >= pii.LEAST_MARGINAL}
        assert set(spans) == set(base) | want
    assert [s for s in pii.find_spans("write to report [at] order.com today", w)[1]] == [(9, 30, "email")]
