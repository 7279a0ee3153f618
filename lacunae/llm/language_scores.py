"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and of pairs of neighbouring words (orders 1 and 2) are gathered over all training documents, each text ended by one end
token, and quantised to levels of a geometric scale. The filter doesn't hold counts: an n-gram of level q is put in q times,
with the numbers 1 to q. Its level is read back by probing with 1, 2, ... until one is missing; so levels are never too low, and too
high by one with the filter's error rate at each step. A word's probability after another smooths the pair's count with the
word's own, added KAPPA times: (c(h w) + KAPPA p(w)) / (c(h) + KAPPA), p(w) = (c(w) + 1) / (N + V + 1), all counts
by levels; what precedes a text's first word is counted by the end token, of which every text has one.

All bits of an entry lie in one 64-bit word of the filter, so a probe is one look. The filter is as large as the corpus asks: counting deals n-grams to buckets whose number grows with the texts, and each bucket sets
the bits of its own part. Parts of up to BROADCAST_BYTES together, with the words' exact counts, are broadcast (the bound is
checked), and each task probes all its n-grams there. A larger filter stays where it is: texts are dealt to chunks, each chunk
asks the parts' tasks for the levels of its distinct n-grams, and the answers meet the chunk's texts again. Both ways probe the same
bits and give the same scores, to rounding; nothing is left out at any size.

Beside the score stands the exact unigram score base_score: sum of log10((c + 1) / (N + V + 1)), c a token's count among N training
tokens of V kinds. Words are told apart by 64-bit hashes.

Null and empty texts are one end token. Repeated rows count in training as often as they stand there and get equal results. A null doc_id
counts as the empty text where documents are held out. Without training documents all counts are 0 and every score is 0. An
empty table gives an empty result. Extra columns are ignored. A very long text is scored whole by one task.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, buckets_for, held_out, map_texts, mix64, small_batches, stored, text_bytes
from .packed_exchange import FAN, FLUSH_PAIRS, SCHEMA, STORE, Gathered, batch_of, bucket_of, bucket_rows, each_bucket, exchange, group_starts, of_kind

#: Ratio of the scale of levels.
SCALE = 1.5
#: Bits set by an entry, all in one word, and bits of the filter for each entry: the error rate is about 1.5 %.
HASHES, ENTRY_BITS = 6, 11
#: Weight of a word's own probability, in counts (of 1, 4, 16, 64 and 256 the best two on held-out texts are 64 and 256).
KAPPA = 64.0
#: The filter and the words' counts together are broadcast up to this size.
BROADCAST_BYTES = 192 << 20
#: Bytes of texts that a chunk has whose n-grams are asked for together.
CHUNK_BYTES = 16 << 20
PAIRS, WORDS = 0, 2  # kinds of rows of the exchange

_STARTS = np.unique(np.ceil(SCALE ** np.arange(108)))  # least count of each level, as far as 64 bits count
_VALUES = np.r_[0, (_STARTS + np.r_[_STARTS[1:] - 1, _STARTS[-1]]) / 2]  # what a level stands for: the middle of its counts


#: Hash of the end token. No word has a blank.
END = xxhash.xxh64_intdigest(b" ")


def tokens_of(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens of the texts, the tokens in turn as places in them (each text's last is the end token, at place 0), and
    the number of tokens of each text."""
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # blanks and the five controls from tab to carriage return
    words = lists.flatten()
    some = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(some)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = words.filter(pa.array(some)).dictionary_encode()
    sizes = np.diff(ends) + 1
    flat = np.zeros(int(sizes.sum()), np.int64)
    flat[np.arange(ends[-1]) + np.repeat(np.arange(len(sizes)), sizes - 1)] = coded.indices.to_numpy() + 1
    digest = map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist())
    return np.r_[np.uint64(END), np.fromiter(digest, np.uint64, len(coded.dictionary))], flat, sizes


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it. The end token of the text before (or of none) stands before a text's first."""
    return mix64(mix64(np.r_[np.uint64(END), h[:-1]]) + h * np.uint64(0x9E3779B97F4A7C15))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_STARTS, counts, "right")


def entries(keys: np.ndarray, order: int, level: int) -> np.ndarray:
    """A hash of each n-gram with a level's number."""
    return mix64(keys + np.uint64((level << 3 | order) * 0xD1342543DE82EF95 & (1 << 64) - 1))


def word_of(entry: np.ndarray, n_words: np.ndarray | np.uint64) -> np.ndarray:
    """The filter's word that an entry's bits are in, of so many words (below 2^32)."""
    return (((entry >> np.uint64(32)) * n_words) >> np.uint64(32)).astype(np.int64)


def mask_of(entry: np.ndarray) -> np.ndarray:
    """The bits of an entry in its word."""
    bits, out = mix64(entry), np.zeros(len(entry), np.uint64)
    for k in range(HASHES):
        out |= np.uint64(1) << ((bits >> np.uint64(6 * k)) & np.uint64(63))
    return out


def part_of(ngrams: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The words of one part of the filter, from (order, keys, levels)."""
    n = sum(int(levels.sum()) for _, _, levels in ngrams)
    out = np.zeros(max(1, math.ceil(n * ENTRY_BITS / 64)), np.uint64)
    for order, keys, levels in ngrams:
        for q in range(1, int(levels.max(initial=0)) + 1):
            entry = entries(keys[levels >= q], order, q)
            np.bitwise_or.at(out, word_of(entry, np.uint64(len(out))), mask_of(entry))
    return out


class Parts:
    """Some or all parts of the filter, with the exact counts of the words in them."""

    def __init__(self, numbers: list[int], bits: list, words: list, counts: list, n_buckets: int):
        """Of each part: its number, and buffers of its filter's words, its words' hashes and their counts."""
        all_of = lambda parts, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind) for x in parts]])
        self.n_buckets, self.bits = n_buckets, all_of(bits, np.uint64)
        self.first, self.sizes = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.uint64)
        sizes = [len(x) // 8 for x in bits]
        self.first[numbers], self.sizes[numbers] = np.cumsum([0, *sizes])[:-1], sizes
        self.words, self.counts = all_of(words, np.uint64), all_of(counts, np.int64)
        order = np.argsort(self.words)
        self.words, self.counts = self.words[order], self.narrow(self.counts[order])

    @staticmethod
    def narrow(counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Levels of n-grams, by probing with 1, 2, ... until one is missing."""
        out = np.zeros(len(keys), np.uint8)
        part = bucket_of(keys, self.n_buckets)
        alive, level = np.flatnonzero(self.sizes[part]), 0
        first, size, keys = self.first[part[alive]], self.sizes[part[alive]], keys[alive]
        while len(alive) and level < len(_STARTS):
            level += 1
            entry = entries(keys, order, level)
            mask = mask_of(entry)
            hit = np.flatnonzero(self.bits[first + word_of(entry, size)] & mask == mask)
            alive, first, size, keys = alive[hit], first[hit], size[hit], keys[hit]
            out[alive] = level
        return out

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Training counts of words."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0).astype(np.int64)


PART_SCHEMA = "bucket int, bits binary, words binary, counts binary, tokens bigint, kinds bigint"


def count_ngrams(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """The written parts of the filter and their number. docs: the training documents."""
    n_buckets = buckets_for(docs.sparkSession, 2 * text_bytes(docs, text_col))
    small_batches(docs.sparkSession)

    def flush(tokens: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        for kind, keys in ((WORDS, tokens), (PAIRS, pairs)):
            keys, many = np.unique(np.concatenate(keys), return_counts=True)
            rows += bucket_rows(n_buckets, keys, None, None, None, many.astype(np.int64), kind=kind)
        return batch_of(rows)

    def ship(batches):
        tokens, pairs, size = [], [], 0
        for batch in batches:
            distinct, at, _ = tokens_of(batch.column(text_col))
            h = distinct[at]
            tokens.append(h), pairs.append(pairs_of(h))
            size += len(h)
            if size >= 2 * FLUSH_PAIRS:
                yield flush(tokens, pairs)
                tokens, pairs, size = [], [], 0
        if size:
            yield flush(tokens, pairs)

    def decide(batches):
        for held in each_bucket(batches):
            ngrams = []
            for kind, order in ((WORDS, 1), (PAIRS, 2)):
                keys, many = Gathered({"a": np.uint64, "many": np.int64}, held, kind).arrays()
                by = np.argsort(keys)
                keys, many = keys[by], many[by]
                starts = np.flatnonzero(group_starts(keys))
                keys, many = keys[starts], np.add.reduceat(many, starts) if len(starts) else many
                if kind == WORDS:
                    words, counts = keys, many
                ngrams.append((order, keys, level_of(many)))
            row = (int(held[0].column("bucket")[0].as_py()), part_of(ngrams).tobytes(), words.tobytes(), counts.tobytes(), int(counts.sum()), len(words))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

    out = arrow_schema(docs.sparkSession, PART_SCHEMA)
    shipped = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(ship, SCHEMA)
    return stored(exchange(shipped, n_buckets).mapInArrow(decide, PART_SCHEMA), "ngram-filter"), n_buckets


def spread(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over each text's tokens; every text has one at least."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else values


SCORED = "n_tokens bigint, n_known bigint, base_score double, score double"


def scored(texts: pa.Array, lookup, n: int, v: int, kappa: float) -> dict:
    """The columns of SCORED. lookup: of distinct words their exact counts and levels, and of distinct pairs their levels."""
    words, at, sizes = tokens_of(texts)
    pairs, pair_at = np.unique(pairs_of(words[at]), return_inverse=True)
    exact, level, pair_level = lookup(words, pairs)
    value = _VALUES[level]
    before = value[np.r_[0, at[:-1]]] if len(at) else value[at]  # the end token, at place 0, stands before a text's first
    own = (value + 1) / (n + v + 1)
    told = (_VALUES[pair_level][pair_at] + kappa * own[at]) / (before + kappa)
    base = np.log10((exact + 1) / (n + v + 1))
    return {"n_tokens": sizes, "n_known": spread((exact > 0).astype(np.int64)[at], sizes), "base_score": spread(base[at], sizes), "score": spread(np.log10(told), sizes)}


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", kappa: float = KAPPA, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, n_tokens, n_known (tokens that training has), base_score, score (both log10), train_tokens. train: whether to learn from a row."""
    spark = docs.sparkSession
    parts, n_buckets = count_ngrams(docs.where(train), text_col)
    sums = parts.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v"), F.sum(F.octet_length("bits") + F.octet_length("words") + F.octet_length("counts")).alias("bytes")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if (sums["bytes"] or 0) <= broadcast_bytes:
        own = spark.sparkContext.broadcast(_whole(parts, n_buckets))

        def make():
            parts = own.value
            return lambda batch: {"doc_id": batch.column("doc_id")} | scored(batch.column("text"), lambda words, pairs: (parts.exact(words), parts.levels(words, 1), parts.levels(pairs, 2)), n, v, kappa)

        got = map_texts(base, ["doc_id", "text"], make, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {SCORED}")
    else:
        got = _scored_by_parts(base, parts, n_buckets, n, v, kappa)
    return got.withColumnRenamed("doc_id", id_col).withColumn("train_tokens", F.lit(n).cast("bigint"))


def _whole(parts: DataFrame, n_buckets: int) -> Parts:
    """All parts on the driver, a column at a time, so that little more than their size is held twice."""
    out = Parts([], [], [], [], n_buckets)

    def joined(column: str, kind: type) -> np.ndarray:
        table = parts.select("bucket", column).toArrow().sort_by("bucket")
        buffers = [x.as_buffer() for x in table[column]]
        if column == "bits":
            sizes = [len(x) // 8 for x in buffers]
            out.first[table["bucket"].to_numpy()], out.sizes[table["bucket"].to_numpy()] = np.cumsum([0, *sizes])[:-1], sizes
        return np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind) for x in buffers]])

    out.bits = joined("bits", np.uint64)
    out.words = joined("words", np.uint64)
    order = np.argsort(out.words)
    out.words = out.words[order]
    out.counts = Parts.narrow(joined("counts", np.int64)[order])
    return out


def _scored_by_parts(base: DataFrame, parts: DataFrame, n_buckets: int, n: int, v: int, kappa: float) -> DataFrame:
    """Scores where the parts stay at their tasks: chunks of texts ask them for the levels of their n-grams."""
    spark = base.sparkSession
    n_chunks = buckets_for(spark, text_bytes(base), CHUNK_BYTES)
    wide = min(n_chunks, FAN)
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(n_chunks)).cast("int")
    dealt = base.withColumn("bucket", chunk).repartitionById(wide, "bucket").sortWithinPartitions("bucket")
    small_batches(spark)

    def ask(batches):
        for held in each_bucket(batches):
            number, waiting, size = int(held[0].column("bucket")[0].as_py()), [], 0
            for batch in [*held, None]:
                if batch is not None:
                    distinct, at, _ = tokens_of(batch.column("text"))
                    waiting.append(distinct[at])
                    size += len(at)
                if size >= FLUSH_PAIRS or batch is None:
                    keys = np.unique(np.concatenate([*waiting, np.array([END], np.uint64)]))
                    pairs = np.unique(np.concatenate([pairs_of(h) for h in waiting] or [np.empty(0, np.uint64)]))
                    for kind, x in ((WORDS, keys), (PAIRS, pairs)):
                        yield batch_of([(kind, k, number, *rest) for _, k, _, *rest in bucket_rows(n_buckets, x, None, None, None, None, kind=kind)])
                    waiting, size = [], 0

    def answer(batches):
        for held in each_bucket(batches):
            own = [(b, k) for b in held for k in of_kind(b, STORE).tolist()]  # one, or none
            part = Parts(*[[b.column(c)[k].as_py() for b, k in own] for c in ("bucket", "b", "docs", "pos")], n_buckets)
            for batch in held:
                rows = []
                for kind in (WORDS, PAIRS):
                    for k in of_kind(batch, kind).tolist():
                        keys, number = np.frombuffer(batch.column("a")[k].as_py(), np.uint64), batch.column("doc_id")[k].as_py()
                        exact = part.exact(keys) if kind == WORDS else np.zeros(0, np.int64)
                        rows.append((kind, number, number, keys.tobytes(), None, exact.tobytes(), None, part.levels(keys, 1 + (kind == PAIRS)).tobytes()))
                yield batch_of(rows)

    def meet(batches):
        for held in each_bucket(batches):
            levels, exact, keys = {}, np.empty(0), {}
            for kind in (WORDS, PAIRS):
                got, many = Gathered({"a": np.uint64, "many": np.uint8}, held, kind).arrays()
                by = np.argsort(got)
                keys[kind], levels[kind] = got[by], many[by]
                if kind == WORDS:
                    exact = Gathered({"docs": np.int64}, held, kind).arrays()[0][by]

            def lookup(words, pairs, keys=keys, levels=levels, exact=exact):
                w, p = np.searchsorted(keys[WORDS], words), np.searchsorted(keys[PAIRS], pairs)
                return exact[w], levels[WORDS][w], levels[PAIRS][p]

            for batch in held:
                at = np.flatnonzero(~np.asarray(batch.column("is_text").is_null()))
                if len(at):
                    batch = batch.take(pa.array(at))
                    told = {"doc_id": batch.column("text_id")} | scored(batch.column("text"), lookup, n, v, kappa)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := told[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SCORED}"
    out = arrow_schema(spark, schema)
    store = parts.selectExpr(f"{STORE} as kind", "bucket", "cast(null as bigint) as doc_id", "cast(null as binary) as a", "bits as b", "words as docs", "counts as pos", "cast(null as binary) as many")
    answers = exchange(dealt.mapInArrow(ask, SCHEMA).unionByName(store), n_buckets).mapInArrow(answer, SCHEMA)
    texts = base.select(chunk.alias("bucket"), F.col("doc_id").alias("text_id"), "text", F.lit(True).alias("is_text"))
    both = answers.unionByName(texts, allowMissingColumns=True)
    return both.repartitionById(wide, "bucket").sortWithinPartitions("bucket", F.col("is_text").asc_nulls_first()).mapInArrow(meet, schema)


def op13_language_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = score_texts(docs, ~held_out("doc_id", 7, 2))
    return got.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
