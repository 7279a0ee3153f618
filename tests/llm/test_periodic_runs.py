"""op12 against a version that tries every lag, with repeats planted in texts."""

import hashlib
import random
import re
from fractions import Fraction

import zlib

import pytest

from lacunae.llm import periodic_runs as pr
from lacunae.llm.registry import REGISTRY


def slow_runs(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and all(stretch[r:] != stretch[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(5)
    out = ["", None, "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x " * 3000, " \t\n"]
    for _ in range(150):
        out.append(" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))))
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 70))]
        body = [rng.choice("abcdefgh") for _ in range(20)] + (unit * rng.randrange(2, 7))[: rng.randrange(1, 400)] + [rng.choice("abcde") for _ in range(10)]
        out.append("  ".join(body))
    long_unit = [f"w{rng.randrange(40)}" for _ in range(700)]
    out.append(" ".join(long_unit * 5))
    return out


def test_like_every_lag(spark):
    made = [(None if k == 3 else k // 2, t, 1) for k, t in enumerate(texts())]
    table = spark.createDataFrame(made, "doc_id bigint, text string, runs int")
    seen = sorted((r.doc_id is not None, r.doc_id or 0, [tuple(x) for x in r.runs], r.n_words, r.collapsed) for r in pr.find_runs(table).collect())
    want = []
    for i, t, _ in made:
        words = (t or "").split()
        runs = slow_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        want.append((i is not None, i or 0, runs, len(words), " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert seen == sorted(want)


def test_query(spark, tmp_path):
    rng = random.Random(6)
    made = [(k, " ".join(rng.choice(("the", "of", "a", "b", "\u00e9", f"w{k}")) for _ in range(rng.randrange(0, 90)))) for k in range(400)] + [(7, None), (None, "a a a a a a a"), (11, "a a a a a a a b"), (11, "a a a a a a a b")]
    spark.createDataFrame([(*r, 1, "x") for r in made], "doc_id bigint, text string, n int, w string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in REGISTRY["op12_periodic_runs"][0](spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in made:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = slow_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert got == sorted(want, key=str)
    assert sum(r[1] for r in want) > 15


def test_classes_cover_all_periods():
    seen = [q for lo, hi in pr.classes(10_000) for q in range(lo, hi + 1)]
    assert seen == list(range(1, len(seen) + 1)) and len(seen) >= 2500


@pytest.mark.parametrize("length, exponent", [(6, 4), (10, 3), (4, 2)])
def test_other_bounds(spark, length, exponent):
    table = spark.createDataFrame([(1, "a b c a b c a b c a b c d d d d d d d d d d e")], "doc_id bigint, text string")
    got = pr.find_runs(table, length=length, exponent=exponent).first()
    assert [tuple(r) for r in got.runs] == [(0, 12, 3), (12, 10, 1)]
