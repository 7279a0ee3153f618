"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of consecutive words of the benchmark items. For patterns of m words a shift table tells, for
each block of two words, how far the search may move on without passing an occurrence; a block that ends a pattern has
shift 0 and leads to the bucket of patterns with that suffix and prefix hash, where the pattern's bytes are compared directly.
Patterns shorter than the window (items with fewer words) have tables of their own, so they don't shorten the others' shifts.

Tables are flat arrays: the shift table is indexed by a hash of the block (blocks that share a place share the smaller shift,
which is always safe), bucket keys are one sorted array, and patterns are places in one buffer of the items' words. A window so
takes some 40 bytes however many items hold it. Words that no item has are in no pattern, so the search jumps over them.

Null or empty texts have no words and no hits. Repeated rows are each judged on their own. An empty benchmark hits nothing; null
and empty items have no windows. Items without an id are hit like others and count together as one item, which no list of ids names. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, stored, texts_of

WINDOW = 10
#: Bytes that the search tables of one broadcast block may have; a larger benchmark is searched for in several blocks, one after another.
BLOCK_BYTES = 256_000_000
#: Bytes of tables for each word of an item, besides its text: key, places, items, its share of the shift table, and, should it be the
#: only one of its kind, its entry among the known words.
WORD_BYTES = 200

#: Bytes of words stay (A-Z in lower case), others become blanks. All bytes of non-ASCII characters belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


_SUFFIX, _PREFIX, _JOIN = 0x5BD1E995, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers
_MASK = (1 << 64) - 1


class WuManber:
    """Search tables for the windows of m words of items. rows: (item, its words), each of at least m words; codes: a number for each word."""

    def __init__(self, m: int, rows: list[tuple[str, list[bytes]]], codes: dict[bytes, int]):
        self.m, self.b, self.codes = m, min(2, m), codes
        self.default = min(255, m - self.b + 1)
        self.items = [item for item, _ in rows]
        sizes = np.array([len(words) for _, words in rows], np.int64)
        total = int(sizes.sum())
        self.buffer = b" ".join(b" ".join(words) for _, words in rows)
        lengths = np.fromiter((len(w) for _, words in rows for w in words), np.int64, total)
        self.places = np.r_[0, np.cumsum(lengths + 1)]  # of each word in the buffer
        h = np.fromiter((codes[w] for _, words in rows for w in words), np.uint64, total)
        per_item = sizes - m + 1
        item = np.repeat(np.arange(len(rows), dtype=np.int32), per_item)
        starts = np.arange(len(item)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(per_item) + per_item, per_item)
        self._shifts(h, starts)
        self._buckets(h, starts, item)

    def _block(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Code of the block whose last word is there."""
        return h[last - 1] * np.uint64(_SUFFIX) + h[last] if self.b == 2 else h[last]

    def _shifts(self, h: np.ndarray, starts: np.ndarray) -> None:
        size = 1 << max(8, (4 * len(h)).bit_length())
        self.mask, table = size - 1, np.full(size, self.default, np.uint8)
        for end in range(self.b, self.m + 1):  # shifts get smaller, so the last one written is the least
            table[self._block(h, starts + end - 1) & np.uint64(self.mask)] = min(self.default, self.m - end)
        self.shift = table.tobytes()

    def _buckets(self, h: np.ndarray, starts: np.ndarray, item: np.ndarray) -> None:
        prefix = np.zeros(len(starts), np.uint64)
        for k in range(self.m - self.b):
            prefix = prefix * np.uint64(_PREFIX) + h[starts + k]
        key = prefix * np.uint64(_JOIN) + self._block(h, starts + self.m - 1)
        order = np.lexsort((item, key))
        key, starts, item = key[order], starts[order], item[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        counts = np.diff(np.r_[first, len(key)])
        for s, n in zip(first[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
            texts = [self._text(x) for x in starts[s : s + n].tolist()]
            if any(t != texts[0] for t in texts):  # different windows of one key: each its own entry
                at = s + np.array(sorted(range(n), key=lambda k: (texts[k], k)))
                starts[s : s + n], item[s : s + n] = starts[at], item[at]
                texts.sort()
                new[s + 1 : s + n] = [a != b for a, b in zip(texts, texts[1:], strict=False)]
        entry = np.cumsum(new) - 1
        self.keys, self.starts = key[new], starts[new]
        told = np.r_[True, (entry[1:] != entry[:-1]) | (item[1:] != item[:-1])] if len(key) else new  # an item counts once an entry
        self.own = item[told]
        self.ends = np.searchsorted(entry[told], np.arange(len(self.keys)), "right")

    def _text(self, start: int) -> bytes:
        return self.buffer[self.places[start] : self.places[start + self.m] - 1]

    def nbytes(self) -> int:
        return len(self.buffer) + len(self.shift) + sum(x.nbytes for x in (self.places, self.keys, self.starts, self.own, self.ends)) + sum(len(i or "") for i in self.items)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence, in order."""
        m, b, n, shift, mask, code_of = self.m, self.b, len(words), self.shift, self.mask, self.codes.get
        keys = memoryview(self.keys)
        end = m
        while end <= n:
            code = code_of(words[end - 1])
            if code is None:  # in no pattern: the next one may begin after this word
                end += m
                continue
            if b == 2:
                before = code_of(words[end - 2])
                if before is None:
                    end += m - 1
                    continue
                code += before * _SUFFIX
            s = shift[code & mask]
            if s:
                end += s
                continue
            start = end - m
            before = list(map(code_of, words[start : end - b]))
            if None in before:
                end += 1
                continue
            prefix = 0
            for c in before:
                prefix = (prefix * _PREFIX + c) & _MASK
            key = (prefix * _JOIN + code) & _MASK
            at = bisect_left(keys, key)
            while at < len(keys) and keys[at] == key:
                if self._text(self.starts[at]) == b" ".join(words[start:end]):
                    yield start, {self.items[k] for k in self.own[self.ends[at - 1] if at else 0 : self.ends[at]]}
                    break
                at += 1
            end += 1


def tables_of(items: list[tuple], window: int = WINDOW) -> list[WuManber]:
    """Search tables of (item_id, text) rows, one for each pattern length."""
    by_length: dict[int, list] = defaultdict(list)
    for item, text in items:
        words = words_of(text)
        if words:
            by_length[min(window, len(words))].append((None if item is None else str(item), words))
    codes: dict[bytes, int] = {}
    for rows in by_length.values():
        for _, words in rows:
            for w in words:
                codes.setdefault(w, len(codes))
    return [WuManber(m, rows, codes) for m, rows in sorted(by_length.items())]


def found(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint spans [start, end) of hit words in order, and the items that hit."""
    spans, items = [], set()
    for table in tables:
        for start, those in table.search(words):
            spans.append((start, start + table.m))
            items |= those
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks whose tables take about block_bytes; each passes through the driver on its own."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("t")).where("t is not null")
    words = F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(F.octet_length("t") + WORD_BYTES * words).alias("n")).first()["n"] or 0
    n = int(total // block_bytes) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(n))) if n > 1 else items.withColumn("block", F.lit(0))
    for k in range(n):
        yield [tuple(r) for r in dealt.where(F.col("block") == k).select("item", "t").collect()]


_RESULT = "doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<bigint>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, word counts, the items found with their digest, and hit spans (starts and ends in turn).

    A benchmark within block_bytes is one broadcast table and needs no shuffle. A larger one is searched for block by block, of
    which one at a time is held anywhere; what the blocks find is stored and joined to the documents by 128 bits of their texts'
    hashes, one row a text that has any.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _RESULT.format(id_type=base.schema["doc_id"].dataType.simpleString())
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _searched(base, spark.sparkContext.broadcast(tables_of(first, window)), schema)
    hits = _hits(base, [first, second], blocks, window)
    hits = hits.groupBy("h1", "h2").agg(F.flatten(F.collect_set("items")).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))

    def finish():
        def work(batch):
            rows = []
            for text, items, flat in zip(texts_of(batch), batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                flat = flat or []
                rows.append(_row(len(words_of(text)), merged(list(zip(flat[::2], flat[1::2], strict=True))), set(items or ())))
            return {"doc_id": batch.column("doc_id")} | _columns(rows)

        return work

    return map_texts(_hashed(base).join(hits, ["h1", "h2"], "left"), ["doc_id", "text", "items", "spans"], finish, schema)


def _hashed(base: DataFrame) -> DataFrame:
    """Two hashes of the text, h1 and h2."""
    return base.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))


def _hits(base: DataFrame, held: list, blocks: Iterator[list[tuple]], window: int) -> DataFrame:
    """h1, h2, items, spans of contaminated texts, once for each block that has any; one block's tables are held at a time."""
    hits, schema = None, "h1 bigint, h2 bigint, " + _RESULT.split(", ", 1)[1]
    while held:
        tables = base.sparkSession.sparkContext.broadcast(tables_of(held.pop(0), window))
        found_ = _searched(_hashed(base), tables, schema, ("h1", "h2")).where("contaminated").select("h1", "h2", "items", "spans")
        found_ = stored(found_, "benchmark-hits")
        tables.unpersist()
        hits = found_ if hits is None else hits.unionByName(found_)
        if not held and (more := next(blocks, None)) is not None:
            held.append(more)
    return hits


def _row(n: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    n_items, items = len(items), sorted(i for i in items if i is not None)
    return n, sum(e - s for s, e in spans), n_items, hashlib.sha256(",".join(items).encode()).hexdigest(), bool(spans), items, [x for span in spans for x in span]


def _columns(rows: list[tuple]) -> dict:
    return dict(zip(("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"), map(list, zip(*rows, strict=True)), strict=True))


def _searched(base: DataFrame, tables, schema: str, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    def make():
        own = tables.value

        def work(batch):
            rows = []
            for text in texts_of(batch):
                words = words_of(text)
                rows.append(_row(len(words), *found(words, own)))
            return {c: batch.column(c) for c in carried} | _columns(rows)

        return work

    return map_texts(base, [*carried, "text"], make, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that hold a window of the benchmark."""
    blocks = benchmark_blocks(benchmark, "item_id", "text", block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _without(docs, docs.sparkSession.sparkContext.broadcast(tables_of(first, window)), text_col)
    hits = _hits(docs.select(F.col(text_col).alias("text")), [first, second], blocks, window).select("h1", "h2").distinct()
    text = docs[text_col]
    return docs.join(hits, (F.xxhash64(text) == hits["h1"]) & (F.xxhash64(F.lit("second"), text) == hits["h2"]), "left_anti")


def _without(docs: DataFrame, tables, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)

    def clean(batches):
        own = tables.value
        for batch in batches:
            keep = [not any(next(t.search(words), None) for t in own) for words in map(words_of, batch.column(text_col).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Same rows in DuckDB: windows of both sides joined on their words, covered positions counted.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms)),
hit AS (SELECT doc_id, p, m, item_id FROM dw JOIN iw USING (m, g)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
