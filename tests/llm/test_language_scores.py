"""op13: exact unigram scores against a plain count, the filter against exact counts, and both ways of probing against each other."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from lacunae.llm import language_scores as ls
from lacunae.llm.common import held_out
from lacunae.llm.registry import REGISTRY


def texts():
    rng = random.Random(9)
    words = [f"w{min(int(rng.paretovariate(0.7)), 900)}" for _ in range(20_000)]
    out = [(k, " ".join(words[50 * k : 50 * k + rng.randrange(1, 50)])) for k in range(400)]
    return [*out, (400, None), (401, ""), (402, " \t"), (403, "UPPER w1 w2\x0bw1 \u00c9 w1"), (None, "w1 w2"), (3, "again w3"), (3, "again w3"), (404, "never seen here"), (405, "w1 " * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in texts()], "doc_id bigint, text string, bucket int, kind string, score double").repartition(4).cache()


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [" "]


def counts():
    one, two = Counter(), Counter()
    for i, t in texts():
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            one.update(tokens(t))
            two.update(pairwise([" ", *tokens(t)]))
    return one, two


def test_base_and_scores(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = REGISTRY["op13_language_scores"][0](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    one, two = counts()
    n, v = one.total(), len(one)
    own = {}
    for i, t in texts():
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        exact = sum(math.log10((two[p, x] + ls.KAPPA * (one[x] + 1) / (n + v + 1)) / (one[p] + ls.KAPPA)) for p, x in pairwise([" ", *w]))
        own.setdefault(i, []).append((len(w), sum(one[x] > 0 for x in w), base, exact))
    rows = got.collect()
    assert len(rows) == len(texts()) and {r.train_tokens for r in rows} == {n}
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2)
        match = [x for x in own[r.doc_id] if x[:2] == (r.n_tokens, r.n_known)]
        assert any(r.base_score == pytest.approx(x[2], rel=1e-9, abs=1e-9) and abs(r.score - x[3]) <= 0.12 * r.n_tokens + 3 for x in match)


def test_both_ways_agree(docs):
    train = ~held_out("doc_id", 7, 2)
    whole = ls.score_texts(docs, train).drop("train_tokens").collect()
    dealt = ls.score_texts(docs, train, broadcast_bytes=0).drop("train_tokens").collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6), round(r.base_score, 6))
    assert Counter(map(key, whole)) == Counter(map(key, dealt))


def test_levels_are_never_too_low():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 60_000).astype(np.uint64)
    many = np.minimum(rng.zipf(1.6, len(keys)), 10**9).astype(np.int64)
    bits = ls.part_of([(1, keys[:100], ls.level_of(many[:100])), (2, keys[100:40_000], ls.level_of(many[100:40_000]))])
    part = ls.Parts([0], [bits.tobytes()], [b""], [b""], 1)
    got, want = part.levels(keys[100:40_000], 2), ls.level_of(many[100:40_000])
    assert (got >= want).all() and (got > want).mean() < 0.03
    assert (part.levels(keys[40_000:], 2) > 0).mean() < 0.03 and (part.levels(keys[:100], 1) >= ls.level_of(many[:100])).all()
    one = np.array([1, 2, 3, 4])
    assert ls._VALUES[ls.level_of(one)].tolist()[:3] == [1, 2, 3]


def test_without_training(spark, docs):
    from pyspark.sql import functions as F

    rows = ls.score_texts(docs, F.lit(False)).collect()
    assert len(rows) == len(texts()) and {(r.score, r.base_score, r.n_known, r.train_tokens) for r in rows} == {(0.0, 0.0, 0, 0)}
    again = ls.score_texts(docs, F.lit(False), broadcast_bytes=-1).collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in again} == {(0.0, 0.0, 0, 0)}


def test_held_out_texts_score_better_than_by_words_alone(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("the test tables aren't here")
    r = REGISTRY["op13_language_scores"][0](spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert r.a > r.b
