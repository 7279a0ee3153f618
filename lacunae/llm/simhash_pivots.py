"""SimHash near-duplicates through pivot distance tables.

A fingerprint's distances to a fixed set of reference fingerprints (pivots) are its row of the pivot table. By the triangle
inequality two fingerprints differ in at least as many bits as their rows differ in any coordinate, so a pair whose rows differ
by more than the wanted distance is discarded, and only survivors are verified bit by bit.

A pivot lets a little over half of random pairs pass, so pivots alone would still have to look at every pair. Which pairs meet
at all is therefore decided by blocks of bits: of distance+e blocks at least e are equal in any linked pair, so fingerprints
meet in one bucket for each choice of e blocks. e is 2, and more for so many fingerprints that buckets of two would be large. Only distinct fingerprints are dealt to buckets, in packed rows. Within a bucket links
are kept as a spanning forest, never as all pairs: in a large bucket each fingerprint is compared only with those that no
earlier one has reached, and where that would still mean too many comparisons, what is left of the bucket is dealt again by the
bits that it hasn't been dealt by yet (cut into distance+1 blocks, one of which is equal in any linked pair). Components then come from label propagation with pointer jumping over written tables.

Null and empty texts have fingerprint zero and link like any other. Rows with equal doc_ids are each given their result; where one
of each component is kept, it is the row with the smallest text hash among those of its smallest doc_id.
A null doc_id is never the smallest id; a component of null ids only has a null component_id. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, hashable, map_texts, mix64, small_batches, stored, texts_of, unused
from .packed_exchange import SCHEMA, Gathered, batch_of, bucket_rows, each_bucket, exchange, group_starts, per_group

SHINGLE = 4
DISTANCE = 4
PIVOTS = 16
#: Buckets up to this size are compared pair by pair at once; in larger ones reached fingerprints are left out.
SMALL_BUCKET = 24
#: Comparisons within one bucket after which the rest of it is dealt by further bits.
BUCKET_WORK = 4_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of shingle words, joined by blanks; of the whole sequence if there are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """Majority bits of each array of hashes: bit is 1 if set in over half of them; no hash gives zero."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    every = np.concatenate([hashes[k] for k in full])
    first = np.cumsum(sizes[full]) - sizes[full]
    chunks = -(-sizes[full] // 255)  # a byte lane counts to 255
    owner = np.repeat(first, chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts, own = owner + 255 * nth, np.cumsum(chunks) - chunks
    for bit in range(8):
        lanes = np.add.reduceat((every >> np.uint64(bit)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), own, axis=0)
        over = 2 * counts > sizes[full][:, None]
        for lane in range(8):
            out[full] |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h, fp: a hash of the text, and the 64-bit fingerprint as a signed integer."""

    def make():
        def work(batch):
            return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "fp": pa.array(fingerprints([shingle_hashes(t, shingle) for t in texts_of(batch)]).view(np.int64))}

        return work

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return map_texts(base, ["doc_id", "text", "h"], make, "doc_id bigint, h bigint, fp bigint")


def bit_blocks(n: int, free: int = (1 << 64) - 1) -> list[np.uint64]:
    """n masks that share out the bits of free (all 64)."""
    bits = [b for b in range(64) if free >> b & 1]
    edges = [len(bits) * k // n for k in range(n + 1)]
    return [np.uint64(sum(1 << b for b in bits[x:y])) for x, y in zip(edges, edges[1:])]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(fps: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Distances of each fingerprint to the pivots."""
    return np.bitwise_count(fps[:, None] ^ pivots(n)[None, :])


def _near(fps, table, i, j, distance: int) -> np.ndarray:
    """Whether fingerprints i and j link: pivot rows first, survivors bit by bit."""
    a, b = table[i], table[j]
    alive = np.flatnonzero((np.maximum(a, b) - np.minimum(a, b)).max(axis=1) <= distance)
    i, j = np.broadcast_arrays(i, j)
    out = np.zeros(len(i), bool)
    out[alive] = np.bitwise_count(fps[i[alive]] ^ fps[j[alive]]) <= distance
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, free: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group of equal keys, all fingerprints that are connected there.

    free: bits by which a group hasn't been dealt yet, of each row or of all.
    """
    free = np.broadcast_to(np.asarray(free, np.uint64), keys.shape)
    order = np.lexsort((fps, keys))
    keys, fps, free = keys[order], fps[order], free[order]
    table = pivot_table(fps)
    starts = np.flatnonzero(group_starts(keys))
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for step in range(1, SMALL_BUCKET):
        i = np.flatnonzero((size_of[:-step] <= SMALL_BUCKET) & (keys[:-step] == keys[step:])) if len(keys) > step else np.empty(0, np.int64)
        if not len(i):
            break
        for part in np.array_split(i, len(i) // 200_000 + 1):
            hit = part[_near(fps, table, part, part + step, distance)]
            left.append(fps[hit]), right.append(fps[hit + step])
    for s, n in zip(starts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist(), strict=True):
        unreached = np.arange(s, s + n)
        queue: list[int] = []
        work = 0
        while len(unreached):
            if not queue:
                queue, unreached = [int(unreached[0])], unreached[1:]
            at = queue.pop()
            work += len(unreached)
            hit = _near(fps, table, unreached, np.array([at]), distance) if len(unreached) else np.empty(0, bool)
            got = unreached[hit]
            if len(got):
                left.append(np.full(len(got), fps[at])), right.append(fps[got])
                queue.extend(got.tolist())
                unreached = unreached[~hit]
            own = int(free[s])
            if work > BUCKET_WORK and own.bit_count() > 2 * distance and len(unreached) > SMALL_BUCKET:
                # what has been compared with all of the rest is done; the rest meets again by other bits
                rest = fps[np.r_[unreached, np.array(queue, np.int64)]]
                for mask in bit_blocks(distance + 1, own):
                    u, v = bucket_links(rest & mask, rest, distance, own & ~int(mask))
                    left.append(u), right.append(v)
                break
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def differing(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For each row: the bits in which the fingerprints of its key differ at all."""
    order = np.argsort(keys, kind="stable")
    new = group_starts(keys[order])
    bits = per_group(np.bitwise_or, fps[order], new) & ~per_group(np.bitwise_and, fps[order], new)
    out = np.empty_like(bits)
    out[order] = bits
    return out


def equal_blocks(n: int, distance: int = DISTANCE, fill: int = 8) -> int:
    """How many blocks must be equal so that n unrelated fingerprints put about `fill` at most in a bucket; at least 2."""
    e = 2
    while n > fill * 2 ** (64 * e / (distance + e)) and e < 6:
        e += 1
    return e


def links(distinct: DataFrame, distance: int = DISTANCE, equal: int | None = None) -> DataFrame:
    """Pairs u < v of linked fingerprints that connect whatever is connected; distinct has one row for each fp."""
    spark = distinct.sparkSession
    n = distinct.count()
    equal = equal or equal_blocks(n, distance)
    chosen = list(combinations(bit_blocks(distance + equal), equal))
    n_buckets = buckets_for(spark, n * len(chosen) * 80)  # a key, a fingerprint, its pivot row and what sorting them takes
    small_batches(spark)

    def deal(batches):
        waiting: list[np.ndarray] = []

        def ship():
            fps = np.concatenate(waiting)
            keys = np.concatenate([mix64((fps & np.bitwise_or.reduce(np.array(c))) ^ mix64(np.array([t + 1], np.uint64))) for t, c in enumerate(chosen)])
            again = np.tile(fps, len(keys) // len(fps))
            waiting.clear()
            return batch_of(list(bucket_rows(n_buckets, keys, None, again.view(np.int64), None, None)))

        for batch in batches:
            waiting.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, waiting)) >= 65_536:
                yield ship()
        if sum(map(len, waiting)):
            yield ship()

    def compare(batches):
        for held in each_bucket(batches):
            keys, fps = Gathered({"a": np.uint64, "docs": np.uint64}, held).arrays()
            # a key tells its choice of blocks no more, so of a bucket only bits that all its fingerprints share are known to be used up
            u, v = bucket_links(keys, fps, distance, differing(keys, fps))
            u, v = u.view(np.int64), v.view(np.int64)
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            for k in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + 100_000, 0]), pa.array(pairs[k : k + 100_000, 1])], names=["u", "v"])

    return exchange(distinct.select("fp").mapInArrow(deal, SCHEMA), n_buckets).mapInArrow(compare, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of the edges (u, v)."""
    both = stored(edges.select("u", "v").union(edges.select("v", "u")), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "labels")
    while True:
        least = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(least, labels["node"] == least["u"], "left").select("node", F.col("label").alias("was"), F.least("label", "m").alias("to"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = stored(lower.join(jump, lower["to"] == jump["n2"], "left").select("node", "was", F.least("to", "l2").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, h, fp, fingerprint (hex), label (one for each component), component_id (smallest doc_id reachable over links)."""
    prints = stored(fingerprint_documents(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(links(distinct, distance))
    known = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = known.join(smallest, "label").select("fp", "label", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "h", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "label", "component_id")


def keep_one_of_each(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, one of each component: of the rows with its smallest doc_id that with the smallest text hash.

    Of rows that repeat that one in id and text, the first by a hash of all columns stays. Rows without an id, which no component
    can be named after, stay. Joining and numbering share one exchange by doc_id.
    """
    rows = near_duplicates(docs, text_col=text_col, **options).where("doc_id = component_id")
    keep = rows.groupBy("label", F.col("doc_id").alias("kept")).agg(F.min("h").alias("kept_h")).select("kept", "kept_h").distinct()
    nth, h, turn = unused(docs, "nth"), unused(docs, "h"), unused(docs, "turn")
    own = docs.where("doc_id is not null").withColumns({h: F.xxhash64(text_col), turn: F.xxhash64(*hashable(docs))})
    own = own.join(keep, (own["doc_id"] == keep["kept"]) & (own[h] == keep["kept_h"]), "left_semi")
    first = own.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(turn))).where(F.col(nth) == 1).drop(nth, h, turn)
    return first.unionByName(docs.where("doc_id is null"))


def op10_simhash_pivots(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
