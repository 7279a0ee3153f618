"""Substring dedup by level-wise doubling of repeated windows.

A window of 13 words can only repeat in another document if the windows of 7 words in it do. So the first level looks for
windows of 7 words that two documents share, and only windows of the next level (up to twice as long) that hold such windows
are looked at again, and so on until the wanted length is reached or no candidate survives (levels() gives the lengths:
7, 13; of a wanted length of 50 they are 7, 13, 25, 50). Each level's findings are written, so a lost executor repeats one level.

A level needs not ship every window: of those that a window of the next level holds, the one with the least hash stands for
it (equal windows choose equal ones), which leaves about one in four. From level to level the hash of a
window of twice the length comes from those of its halves. Windows of the last level are compared by 96 bits of hash.

Keys are dealt to buckets whose number grows with the bytes of the texts, so that a task's share stays bounded.

Null texts have no words. Rows with equal doc_ids count as one document: neither makes the other's windows repeated. Each of
their texts still loses its own repeated windows only: findings carry the number of the text among those of its doc_id. A document
of fewer words than a window keeps all of them. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, buckets_for, map_texts, mix64, partitions, small_batches, stored, text_bytes, texts_of
from .packed_exchange import FLUSH_PAIRS, SCHEMA, Gathered, batch_of, bucket_rows, by_owner, each_bucket, exchange, group_starts, of_kind, owner_rows, per_group

WINDOW = 13
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers of two rolling hashes


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


_HASHES = Memo(_word_hash)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII blanks, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each window of so many words, doubled from windows of half the length: H(2k) at p = H(k) at p + base^k * H(k) at p+k."""
    if length == 1:
        return h
    half = length // 2
    part = rolled(h, half, base)
    n = len(h) - 2 * half + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = part[:n] + np.uint64(pow(base, half, 1 << 64)) * part[half : half + n]
    if length % 2:
        out = out[:-1] + np.uint64(pow(base, length - 1, 1 << 64)) * h[length - 1 :]
    return out


def levels(window: int, least: int = 7) -> list[int]:
    """Lengths from level to level, each at most twice the one before, the last the wanted one. None but the first is below `least`."""
    out = [window] if window > 1 else [1, 1]
    while out[0] > 1 and (len(out) == 1 or (out[0] + 1) // 2 >= least):
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(h: np.ndarray, window: int, first: int) -> np.ndarray:
    """For each window start: the least mixed hash of the windows of the first length in it."""
    m = mix64(rolled(h, first, _B1))
    n = len(h) - window + 1
    out = m[:n].copy()
    for k in range(1, window - first + 1):
        np.minimum(out, m[k : k + n], out=out)
    return out


class _Pairs:
    """Pairs a map task gathers; full() tells when to flush."""

    def __init__(self, n: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.size = 0

    def add(self, *arrays: np.ndarray) -> None:
        for p, x in zip(self.parts, arrays, strict=True):
            p.append(x)
        self.size += len(arrays[0])

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(p) for p in self.parts]
        self.parts, self.size = [[] for _ in self.parts], 0
        return out


def survivors(h: np.ndarray, length: int, before: int | None, shared: np.ndarray | None) -> np.ndarray:
    """For each window of this length: whether the windows of the level before let it repeat (all may, at the first level)."""
    if before is None:
        return np.ones(max(0, len(h) - length + 1), bool)
    return np.isin(anchors(h, length, before), shared)


def _level(candidates: DataFrame, length: int, nxt: int, before: int | None, n_buckets: int) -> DataFrame:
    """Per document with any: the anchors of windows of the next length that it shares with another document, packed (doc_id, found).

    candidates: doc_id, text, and from the second level on found, the anchors shared at the level before.
    """

    def flush(pairs: _Pairs):
        a, docs = pairs.take()
        order = np.lexsort((docs, a))
        a, docs = a[order], docs[order]
        keep = group_starts(a, docs)  # a document counts once
        a, docs = a[keep], docs[keep]
        new = group_starts(a)
        many = per_group(np.add, np.ones(len(a), np.int64), new) > 1
        # what repeats within the task is decided here; one pair tells the others
        rows = list(bucket_rows(n_buckets, a[new], None, docs[new], None, many[new].astype(np.int8)))
        rows += owner_rows(n_buckets, docs[many], a[many])
        return batch_of(rows)

    def ship(batches):
        pairs = _Pairs(2)
        for batch in batches:
            found = batch.column("found").to_pylist() if before else [None] * batch.num_rows
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), texts_of(batch), found, strict=True):
                words = words_of(text)
                if len(words) >= nxt:
                    h = hashes_of(words)
                    a = anchors(h, nxt, length)
                    if before:  # a window of the next length can repeat only if all windows of this length in it can
                        dead = np.r_[0, np.cumsum(~survivors(h, length, before, np.frombuffer(own, np.uint64)))]
                        a = a[dead[nxt - length + 1 :] == dead[: len(a)]]
                    a = np.unique(a)
                    pairs.add(a, np.full(len(a), doc, np.int64))
                    if pairs.size >= FLUSH_PAIRS:
                        yield flush(pairs)
        if pairs.size:
            yield flush(pairs)

    def decide(held):
        a, docs, many = Gathered({"a": np.uint64, "docs": np.int64, "many": np.int8}, held).arrays()
        order = np.argsort(a, kind="stable")
        a, docs, many = a[order], docs[order], many[order]
        new = group_starts(a)
        if len(a):
            shared = (per_group(np.minimum, docs, new) != per_group(np.maximum, docs, new)) | (per_group(np.maximum, many, new) > 0)
            open_ = shared & (many == 0)
            if open_.any():
                yield batch_of(list(owner_rows(n_buckets, docs[open_], a[open_])))

    small_batches(candidates.sparkSession)
    return _decided(candidates, ship, decide, n_buckets, lambda batches: ((doc, a.tobytes()) for doc, a in by_owner(batches, np.uint64)))


def _last_level(candidates: DataFrame, window: int, before: int, n_buckets: int) -> DataFrame:
    """Per document with any: runs of window starts that also start in a document with a smaller id, packed (doc_id, found).

    A start is its place in the text with the text's number (nth, of candidates) in the upper half.
    """

    def flush(pairs: _Pairs):
        a, b, docs, pos = pairs.take()
        order = np.lexsort((docs, b, a))
        a, b, docs, pos = a[order], b[order], docs[order], pos[order]
        new = group_starts(a, b)
        later = docs > per_group(np.minimum, docs, new)
        ship = ~later
        rows = list(bucket_rows(n_buckets, a[ship], b[ship], docs[ship], pos[ship], None))
        return batch_of([*rows, *owner_rows(n_buckets, docs[later], pos[later])])

    def ship(batches):
        pairs = _Pairs(4)
        for batch in batches:
            for doc, nth, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("nth").to_pylist(), texts_of(batch), batch.column("found").to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                h = hashes_of(words)
                at = np.flatnonzero(survivors(h, window, before, np.frombuffer(found, np.uint64)))
                pairs.add(mix64(rolled(h, window, _B1))[at], mix64(rolled(h, window, _B2))[at].astype(np.uint32), np.full(len(at), doc, np.int64), at | nth << 32)
                if pairs.size >= FLUSH_PAIRS:
                    yield flush(pairs)
        if pairs.size:
            yield flush(pairs)

    def decide(held):
        a, b, docs, pos = Gathered({"a": np.uint64, "b": np.uint32, "docs": np.int64, "pos": np.int64}, held).arrays()
        order = np.lexsort((b, a))
        a, b, docs, pos = a[order], b[order], docs[order], pos[order]
        if len(a):
            later = docs > per_group(np.minimum, docs, group_starts(a, b))
            if later.any():
                yield batch_of(list(owner_rows(n_buckets, docs[later], pos[later])))

    small_batches(candidates.sparkSession)
    return _decided(candidates, ship, decide, n_buckets, lambda batches: ((doc, packed_runs(pos)) for doc, pos in by_owner(batches, np.int64)))


def _decided(source: DataFrame, ship, decide, n_buckets: int, of_documents) -> DataFrame:
    """doc_id, found: keys are shipped to their buckets and decided there (decide takes one bucket's rows), findings go on to their
    documents' buckets."""

    def collect(batches):
        rows = []
        for row in of_documents(batches):
            rows.append(row)
            if len(rows) == 5000:
                yield found_batch(rows)
                rows = []
        if rows:
            yield found_batch(rows)

    def decide_each(batches):
        for held in each_bucket(batches):
            for batch in held:
                yield batch.take(pa.array(of_kind(batch, 1)))
            yield from decide(held)

    decided = exchange(source.mapInArrow(ship, SCHEMA), n_buckets).mapInArrow(decide_each, SCHEMA)
    return exchange(decided, n_buckets).mapInArrow(collect, "doc_id bigint, found binary")


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    docs, found = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "found"])


def packed_runs(at: np.ndarray) -> bytes:
    """Starts and lengths, in turn, of the runs of consecutive places in sorted at."""
    new = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    return np.stack([at[new], np.diff(np.r_[new, len(at)])], axis=1).astype("<i8").tobytes()


def covered(n: int, window: int, runs: bytes, nth: int = 0) -> np.ndarray:
    """Which of n words of the text with this number lie in a flagged window."""
    edge = np.zeros(n + 1, np.int64)
    runs = np.frombuffer(runs, "<i8").reshape(-1, 2)
    runs = runs[runs[:, 0] >> 32 == nth] & 0xFFFFFFFF
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + window, -1)
    return np.cumsum(edge[:n]) > 0


def find_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, nth, found: the runs of window starts (packed starts and lengths) that also start in a smaller doc_id.

    nth numbers the different texts of one doc_id from 0; found has the runs of all of them, each start with its text's number.
    Integer ids only; rows with a null id are never compared and keep their words.
    """
    spark, lengths = docs.sparkSession, levels(window)
    n_buckets = buckets_for(spark, text_bytes(docs, text_col))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if (id_col, text_col, docs.schema[id_col].dataType.simpleString()) == ("doc_id", "text", "bigint"):
        base = docs.select("doc_id", "text")  # without aliases the plans of both joins' sides are equal
    known = base.where("doc_id is not null")
    if n_buckets > partitions(spark):
        known = known.repartition(n_buckets, "doc_id")
    unknown = base.where("doc_id is null").withColumns({"nth": F.lit(0).cast("bigint"), "found": F.lit(None).cast("binary")})
    source, before, alive = known, None, True
    for length, nxt in zip(lengths, lengths[1:], strict=False):
        shared = stored(_level(source, length, nxt, before, n_buckets), f"repeats-{length}")
        alive = not shared.isEmpty()
        if not alive:
            break
        source, before = known.join(shared.hint("merge"), "doc_id"), length
    # dealt by doc_id once: the window and both joins read the same exchange
    known = known.withColumn("nth", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) - 1).cast("bigint"))
    if not alive:  # no candidate survives: nothing repeats
        return known.withColumn("found", F.lit(None).cast("binary")).unionByName(unknown)
    runs = _last_level(known.join(shared.hint("merge"), "doc_id"), window, before or 0, n_buckets)
    return known.join(runs.hint("merge"), "doc_id", "left").unionByName(unknown)


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by blanks)."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"

    def make():
        def work(batch):
            rows = []
            for text, nth, runs in zip(texts_of(batch), batch.column("nth").to_pylist(), batch.column("found").to_pylist(), strict=True):
                words = words_of(text)
                kept = words
                if runs:
                    kept = [w for w, gone in zip(words, covered(len(words), window, runs, nth).tolist(), strict=True) if not gone]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")))
            return {"doc_id": batch.column("doc_id")} | dict(zip(("n_words", "n_removed", "kept_sha256", "kept"), map(list, zip(*rows, strict=True)), strict=True))

        return work

    return map_texts(find_repeats(docs, window, **options), ["doc_id", "text", "nth", "found"], make, schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM s) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM f),
k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
