"""The registered queries as they are: column names, digests and string forms, on a folder of small tables and on empty ones."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacunae.llm import language_cnn as lc
from lacunae.llm import mpeg_audio as ma
from lacunae.llm import simhash_pivots as sp
from lacunae.llm import token_planes as tp
from lacunae.llm.registry import REGISTRY

from .test_operators import BENCHMARK, SCHEMA, rows, slow_components, slow_removal
from .test_small_functions import slow_spans

TEXTS = [r[:2] for r in rows()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("full"))
    spark.createDataFrame([(*r, 1, 5, 0.5, 7, 3, b"z", 9, 8, 7, 6, "k", 2) for r in rows()], SCHEMA).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(0, 240, 2)] + [(None, 0, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", REGISTRY)
def test_empty_tables(spark, empty_folder, name):
    assert REGISTRY[name][0](spark, empty_folder).count() == 0


def test_pipeline_of_empty_tables(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def test_mix_rows(spark, folder):
    got = REGISTRY["op1_pivotal_mix"][0](spark, folder)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    first, again = got.collect(), REGISTRY["op1_pivotal_mix"][0](spark, folder).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again)) and len(first) == len(TEXTS)


def test_planes_rows(spark, folder):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(tp.default_tokenizer()), 0
    texts = {i: t or "" for i, t in TEXTS}
    for r in sorted(REGISTRY["op2_token_planes"][0](spark, folder).collect(), key=lambda r: r.start):
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_toxicity_rows(spark, folder):
    for r in REGISTRY["op4_toxicity_mil"][0](spark, folder).collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and len(r.offending) % 2 == 0


def test_substring_rows(spark, folder):
    assert Counter(map(tuple, REGISTRY["op6_substring_dedup"][0](spark, folder).collect())) == slow_removal(TEXTS, 13)


def test_language_rows(spark, folder):
    got = REGISTRY["op7_language_cnn"][0](spark, folder).collect()
    assert len(got) == len(TEXTS) and {r.lang_pred for r in got} <= {"en", "fr", "de", "und"}
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)


def test_held_out_languages_are_never_read(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    flipped = docs.withColumn("lang", F.when(lc.held_out("doc_id", 3, 1), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    one, two = lc.fit(docs), lc.fit(flipped)
    assert one.languages == two.languages and all(np.array_equal(a, b) for a, b in zip([one.embedding, *one.filters, one.dense], [two.embedding, *two.filters, two.dense], strict=True))


def test_media_rows(spark, folder):
    want = Counter()
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = ma.padded(raw)
        data = ma.encode(payload, len(raw))
        n = len(payload) // 576
        offsets = [data.index(b"\xff\xfa", 10)]  # the table's frame, then one for each 576 bytes
        for pad in (0, *ma.paddings(n)):
            offsets.append(offsets[-1] + 626 + int(pad))
        seek = hashlib.sha256(np.array(offsets[1:-1], "<i8").tobytes()).hexdigest()[:16]
        feature = f"frames={n};table={n};bytes={len(data) - offsets[0]};samples={1152 * n};rate=44100;checked={n + 1};damaged=0;resyncs=0;seek={seek}"
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, 1152 * n / 44100, tuple(offsets[1:-1])] += 1
    got = REGISTRY["op8_mpeg_audio"][0](spark, folder).collect()
    assert Counter((*r[:-1], tuple(r[-1])) for r in got) == want


def test_secret_rows(spark, folder):
    names, want = ("assign", "access", "hex"), Counter()
    for i, t in TEXTS:
        spans = slow_spans(t or "")
        want[i, *(sum(k == n for k, _, _ in spans) for n in range(3)), sha(",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans))] += 1
    got = REGISTRY["op9_secret_ledger"][0](spark, folder).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    for r in got:
        base = [x for x in r.spans.split(",") if x.split(":")[0] in names]
        assert sha(",".join(base)) == r.base_sha256


def test_near_duplicate_rows(spark, folder):
    assert Counter(map(tuple, REGISTRY["op10_simhash_pivots"][0](spark, folder).collect())) == slow_components(TEXTS)


def test_one_of_each_component_whatever_the_order(spark):
    base = " ".join(f"word{n}" for n in range(60))
    table = [(1, base, "a"), (2, base, "b"), (2, "another text of the same id", "c"), (2, "another text of the same id", "d"), (3, None, "e"), (4, "", "f"), (None, base, "g")]
    seen = set()
    for n in (1, 3, 7):
        docs = spark.createDataFrame(table, "doc_id bigint, text string, h string").repartition(n)
        seen.add(tuple(sorted(map(str, sp.keep_one_of_each(docs).collect()))))
    (kept,) = seen
    assert len(kept) == 4 and sum("another text" in k for k in kept) == 1 and sum("doc_id=3" in k for k in kept) == 1


def test_hot_bucket_of_unlinked_fingerprints():
    """Fingerprints that share two blocks but are far apart otherwise: no comparison of all pairs, every link found."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) & ~((1 << 21) - 1) for _ in range(6000)]
    fps = np.unique(np.array([c ^ sum(1 << b for b in rng.sample(range(21, 64), rng.randrange(5))) for c in centres for _ in range(3)], np.uint64))
    keys = np.zeros(len(fps), np.uint64)
    whole = (1 << 64) - (1 << 21)

    def labels(u, v):
        up = {}
        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            a, b = sorted((root(a), root(b)))
            up[b] = a
        return {x: root(x) for x in fps.tolist()}

    split = labels(*sp.bucket_links(keys, fps, 4, sp.differing(keys, fps)))
    assert int(sp.differing(keys, fps)[0]) == whole
    assert split == labels(*sp.bucket_links(keys, fps, 4))
