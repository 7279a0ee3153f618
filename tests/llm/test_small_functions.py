"""Parts of the training-data operators that need no session, against plainer versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lacunae.llm import benchmark_decontamination as bd
from lacunae.llm import language_cnn as lc
from lacunae.llm import mpeg_audio as ma
from lacunae.llm import pivotal_mix as pm
from lacunae.llm import secret_ledger as sl
from lacunae.llm import simhash_pivots as sp
from lacunae.llm import substring_dedup as sd
from lacunae.llm import token_counts as tc
from lacunae.llm import token_planes as tp
from lacunae.llm import toxicity_mil as tm

ODD = ["", " ", "  a", "a\x1cb", "ΑΣ ΣΑΣ", "it's DON'T  x<|endoftext|>y", "İstanbul ß ﬁ", "é ́x", "A.B, c!! D? 12,5", "a\tb\r\nc\x85d", "K ſ", "Über, ÜBER.", "日本語 テキスト", "🙂🙂 ok", "<s> <0x0A>", "x" * 5000, "ab" * 3000]


def test_tokens_equal_the_librarys():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tp.default_tokenizer()), tp.Encoder(tp.default_tokenizer())
    want = [library.encode(text, add_special_tokens=False).ids for text in ODD]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(ODD))] == want
    for text, ids in zip(ODD, want, strict=True):
        assert np.frombuffer(tp.Encoder(tp.default_tokenizer()).encode(pa.array([text]), b"\2\0\0\0")[0], "<u4").tolist() == [*ids, 2]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans(), st.sampled_from([1, 7, 64]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, bits, block):
    raw = np.array(ids, "<u4").tobytes()
    payload, index = tp.pack(raw, block, bits)
    assert tp.unpack(payload, index, len(ids), block, bits) == raw
    assert index[-1] == len(payload)


def unigram():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    t = Tokenizer(Unigram(tc.vocabulary(tc.default_model()), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_librarys():
    library, own = unigram(), tc.Counter(tc.vocabulary(tc.default_model()))
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aeinrst thdé,.\n中") for _ in range(rng.randrange(80))) for _ in range(300)]
    for text in texts:
        assert own.text(text)[0] == len(library.encode(text, add_special_tokens=False).ids), text


@given(st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=8), st.text("abc", max_size=30))
@settings(max_examples=200, deadline=None)
def test_viterbi_ties(pieces, word):
    """Against the plain forward dynamic programme: starts ascending, only a higher score replaces."""
    vocabulary = [(p, -float(len(p) % 3)) for p in dict.fromkeys(pieces)]
    scores, low = dict(vocabulary), min(s for _, s in vocabulary) - tc.UNKNOWN_PENALTY
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(len(word)):
        ends = [(i + n, scores[word[i : i + n]], 1) for n in range(1, 5) if word[i : i + n] in scores and i + n <= len(word)]
        if not any(e == i + 1 for e, _, _ in ends):
            ends.append((i + 1, low, len(word[i].encode())))
        for e, s, c in ends:
            if best[e] is None or best[i][0] + s > best[e][0]:
                best[e] = (best[i][0] + s, best[i][1] + c)
    assert tc.Counter(vocabulary).word(word) == (best[-1][1], best[-1][0])


@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_wu_manber_finds_all(text, items, window):
    words = [w.encode() for w in text]
    spans, found = bd.found(words, bd.tables_of([(k, " ".join(i)) for k, i in enumerate(items)], window))
    hit, want = set(), set()
    for k, item in enumerate(items):
        m = min(window, len(item))
        for p in range(len(item) - m + 1 if m else 0):
            for q in range(len(text) - m + 1):
                if text[q : q + m] == item[p : p + m]:
                    hit.update(range(q, q + m))
                    want.add(str(k))
    assert {x for s, e in spans for x in range(s, e)} == hit and found == want


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_rolled_hash(values, length):
    h = np.array(values, np.uint64)
    want = [sum(v * pow(sd._B1, k, 1 << 64) for k, v in enumerate(values[p : p + length])) % 2**64 for p in range(len(values) - length + 1)]
    assert sd.rolled(h, length, sd._B1).tolist() == want


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = regex.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_fingerprints():
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["a", "B", "é", "the", "x\ty"]) for _ in range(n)) for n in (1, 3, 4, 5, 250, 258, 259, 260, 600)]
    assert sp.fingerprints([sp.shingle_hashes(t) for t in texts]).tolist() == [slow_fingerprint(t) for t in texts]


def test_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 30).astype(np.uint64)
    flip = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) for _ in range(40)]
    fps = np.unique(np.concatenate([centres] + [centres ^ x for x in flip]))
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(int(fps[i])), find(int(fps[j]))
        root[max(a, b)] = min(a, b)
    want = [find(int(x)) for x in fps]
    for keys in (np.zeros(len(fps), np.uint64),):
        root = {int(x): int(x) for x in fps}
        for a, b in zip(*sp.bucket_links(keys, fps), strict=True):
            assert int(a ^ b).bit_count() <= 4
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        assert [find(int(x)) for x in fps] == want


def test_move_keeps_mass_and_expectation():
    rng = random.Random(6)
    for _ in range(300):
        p, q, s, r = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randint(1, 500), rng.randint(1, 500)
        gain, lose = min((1 - p) * s, q * r), min(p * s, (1 - q) * r)
        up, down = pm.move(p, s, q, r, 0.0), pm.move(p, s, q, r, 1 - 1e-12)
        for a, b in (up, down):
            assert a * s + b * r == pytest.approx(p * s + q * r)
            assert a in (0.0, 1.0) or b in (0.0, 1.0)
        share = lose / (gain + lose)
        assert share * up[0] + (1 - share) * down[0] == pytest.approx(p)


def test_round_group_leaves_one():
    rng = random.Random(7)
    ps, sizes, us = [rng.random() for _ in range(500)], [rng.randint(1, 900) for _ in range(500)], [rng.random() for _ in range(500)]
    got, open_ = pm.round_group(ps, sizes, us)
    assert all(p in (0.0, 1.0) for k, p in enumerate(got) if k != open_)
    assert sum(p * s for p, s in zip(got, sizes, strict=True)) == pytest.approx(sum(p * s for p, s in zip(ps, sizes, strict=True)), abs=1e-3)


def slow_spans(text):
    out = []
    for m in regex.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, regex.ASCII):
        if len(m[2]) >= 6:
            out.append((0, *m.span()))
    out += [(1, *m.span()) for m in regex.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(2, *m.span()) for m in regex.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], x[0]))


@given(st.lists(st.sampled_from(["password", "Token", "API_KEY", "apikey", "secret", ":", "=", " ", "'", '"', "abcdef", "0123456789abcdef", "AKIA", "QWERTY12345678", "x", "é", "ſecret", "."]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert [x for x in sl.spans_of(text) if x[0] < 3] == slow_spans(text)


def test_media_round_trip_and_damage():
    for n in (0, 1, 575, 576, 577, 40_000):
        raw = bytes(k * 7 % 256 for k in range(n))
        media = ma.encode(ma.padded(raw), n)
        s = ma.parse(media)
        assert ma.decode(media, s) == ma.padded(raw)
        assert (s.checked, s.damaged, s.resyncs) == (len(s.offsets) + 1, 0, 0)
        assert s.table["frames"] == len(s.offsets) and s.table["bytes"] == len(media) - s.offsets[0] + 626
        assert s.samples == 1152 * len(s.offsets) and s.tag == {"TXXX:n_bytes": str(n)}
        assert s.seek(0) == s.offsets[0] and s.seek(1e9) == s.offsets[-1]
    broken = bytearray(media)
    broken[s.offsets[3] + 8] ^= 1  # side information of a protected frame
    assert ma.parse(bytes(broken)).damaged == 1
    cut = media[: s.offsets[5]] + media[s.offsets[5] + 100 :]  # bytes are missing
    t = ma.parse(cut)
    assert t.resyncs == 1 and len(t.offsets) == len(s.offsets) - 1
    assert ma.parse(b"no audio \xff\xfb").offsets == [] and ma.parse(b"").samples == 0
    assert ma.crc16(b"123456789") == 0xAEE7


def test_header_sizes():
    h = ma.parse_header(bytes((0xFF, 0xFB, 0x90, 0)))
    assert (h.version, h.layer, h.kbps, h.rate, h.size, h.samples, h.side_size) == (1, 3, 128, 44100, 417, 1152, 32)
    assert ma.parse_header(bytes((0xFF, 0xE3, 0x40, 0xC0))).rate == 11025
    assert ma.parse_header(b"\xff\xff\xff\xff") is None and ma.parse_header(b"\xff") is None


def test_pooled_filters_equal_plain_convolution():
    rng = np.random.default_rng(1)
    f = len(lc.WIDTHS) * lc.FILTERS
    net = lc.Network(["a", "b"], rng.normal(size=(64, 8)), [rng.normal(size=(w * 8, lc.FILTERS)) for w in lc.WIDTHS], rng.normal(size=f), rng.normal(size=(f, 2)), rng.normal(size=2))
    texts = ["hello", "é" * 300, "x" * 256, "The quick brown fox " * 40, ""]
    got = lc.Predictor(net, windows_at_once=2).predict(texts)
    for text, p in zip(texts, got, strict=True):
        c = lc.classes_of(text).tolist()
        n = max(1, -(-len(c) // lc.STRIDE))
        c += [lc.PAD] * (n * lc.STRIDE - len(c) + 3)
        total, weights = 0, 0
        for k in range(n):
            pooled = [np.max([np.concatenate([net.embedding[x] for x in c[at : at + w]]) @ fil for at in range(k * lc.STRIDE, (k + 1) * lc.STRIDE)], axis=0) for w, fil in zip(lc.WIDTHS, net.filters, strict=True)]
            weight = min(lc.STRIDE, max(1, len(lc.classes_of(text)) - k * lc.STRIDE))
            total, weights = total + weight * net.probabilities(np.concatenate(pooled)[None])[0], weights + weight
        assert p == pytest.approx(total / weights, abs=1e-4)


def test_noisy_or_and_sentences():
    assert tm.noisy_or(np.array([0.0, 0.0])) == pytest.approx(0.75)
    assert tm.noisy_or(np.full(3, -40.0)) == pytest.approx(3 * np.exp(-40.0))
    text, spans = "One two. Bad words!\nEnd é", [(0, 7), (8, 18), (19, 19), (20, 25)]
    assert [len(s) for s in tm.sentences_of(text)] == [len(text[a:b].split()) for a, b in spans]
    assert tm._spans(text, list(range(len(spans)))) == spans
    assert len(tm.features_of(b"abcdef")) == 3 and tm.features_of(b"abc") == [zlib.crc32(b"abc") % tm.FEATURES]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
