"""Token ids written as bit- or byte-planes.

Every text is encoded with the tokenizers library (where the tokenizer's file allows it, each distinct word once); the end id
follows each document. Documents are dealt to shards by ranges of doc_id and text hash and sorted, so the shards in order hold all ids in ascending doc_id order. A shard is a list of chunks, each with
the ids of some whole documents; a chunk's ids are cut into blocks of a fixed size, each block transposed into planes (the
first byte or bit of every id, then the second, ...), and each plane compressed with zstandard. A chunk's index gives where
each plane begins, so that a block or a plane can be read alone. Chunks are rows of a Parquet table in the shared folder:
Spark's commit protocol makes the files whole even if executors are lost, and any store that Spark reaches can hold them.

Null texts count as empty: only the end id is written. Rows with equal doc_ids follow each other in the order of their texts'
hashes; rows with a null doc_id come first. An empty table gives no chunks. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, arrow_schema, buckets_for, fresh_path, small_batches, text_bytes

END_ID = 2
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 18
LEVEL = 3
#: Bytes of text that are encoded at once.
GATHER_BYTES = 8_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a tokenizer's file must say for texts to be encoded word by word. Fixed values of the format.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_words(tokenizer: dict) -> bool:
    """Whether a tokenizer (the parsed file) lower-cases, cuts at white space first, marks words' ends, and adds nothing to a text."""
    normal, cut, model = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}, tokenizer["model"]
    return (
        normal.get("normalizers") == WORD_NORMALIZERS
        and [x if x["type"] == "Split" else x["type"] for x in cut.get("pretokenizers", ())] == [WORD_SPLIT, "ByteLevel"]
        and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
        and not tokenizer.get("truncation") and not tokenizer.get("padding")
        and all(x["content"].startswith("<|") for x in tokenizer.get("added_tokens", ()))
    )


class WholeTexts:
    """Ids of whole texts by the library, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()

    def encode(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() + end for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]


class Encoder:
    """Ids of whole texts, by a memo of blank-separated words, for tokenizers of which by_words holds.

    Such a tokenizer cuts at white space before anything else, and its normaliser never composes characters across a blank, so
    a text's ids are those of its blank-separated words in turn, whatever stands in the same batch. ASCII letters and the marks after
    them are also cut apart.
    """

    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.ids = Memo(self._miss, most)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.word_ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.word_ends[[k for piece, k in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True

    def _library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32).astype("<u4").tobytes()

    def _miss(self, word: str) -> bytes:
        if word.isascii():
            if word[-1:] in self.MARKS and word[:-1].isalpha():
                return self.ids[word[:-1]] + self.ids[word[-1]]
            if word.isalpha() and not word.islower():
                return self.ids[word.lower()]
        return self._library(word)

    def prepare(self, words: list[str]) -> None:
        """Encode many unseen words in a few calls of the library: words of Latin letters in one text, as each ends with the one
        id that carries the end-of-word mark, and the others as a batch. Lower-case ASCII words need no normalising or cutting
        beyond blanks, so they go to a tokenizer of the same vocabulary without those steps."""
        ids, new = self.ids, set()
        for w in [w for w in words if w not in ids]:
            core = w[:-1] if w[-1:] in self.MARKS and w.isascii() else w
            core = core.lower() if core.isascii() else core
            if core not in ids:
                new.add(core)
        if len(ids) + len(new) >= ids.most:
            ids.clear()
        done: set[str] = set()
        latin = {w for w in new if w.isalpha() and max(w) < "\u0250"}
        ascii_ = [w for w in latin if w.isascii()]
        for tokenizer, words in ((self.bare, ascii_), (self.tokenizer, list(latin.difference(ascii_)))):
            got = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.word_ends[got]) + 1
            if len(ends) == len(words):  # else some word has several ends or none: word by word then
                raw, at = got.tobytes(), (4 * ends).tolist()
                ids.update(zip(words, (raw[a:b] for a, b in zip([0, *at], at, strict=False)), strict=True))
                done.update(words)
        others = list(new.difference(done))
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            ids[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Each distinct word is looked up once."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten()
        # of words of ASCII letters lower-casing is the tokenizer's first effect. Not of others, which it composes first (J and a caron after
        # it stay two characters, j and a caron become one), nor of what may be a special token, whose case counts
        plain = pc.and_not(pc.string_is_ascii(words), pc.match_substring(words, "<|"))
        words = pc.if_else(plain, pc.ascii_lower(words), words).dictionary_encode()
        distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        self.prepare(distinct)
        parts = list(map(self.ids.__getitem__, distinct))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        flat = pool[np.repeat(first[codes] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = (4 * np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [flat[a:b] + end for a, b in zip(at, at[1:])]


def planes_of(ids: bytes, bits: bool = False) -> list[bytes]:
    """The planes of one block of 32-bit ids."""
    table = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    if bits:
        return [row.tobytes() for row in np.packbits(np.unpackbits(table, axis=1).T, axis=1)]
    return [row.tobytes() for row in np.ascontiguousarray(table.T)]


def ids_of(planes: list[bytes], n: int) -> bytes:
    """The ids of one block from its 4 byte planes or 32 bit planes."""
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 32:
        return np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1).tobytes()
    return np.ascontiguousarray(rows.T).tobytes()


def pack(ids: bytes, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = LEVEL) -> tuple[bytes, list[int]]:
    """A chunk's payload and its index: the place of each plane's first byte, and last the payload's size."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    parts, index, at = [], [0], 0
    for k in range(0, len(ids), 4 * block_ids):
        for plane in planes_of(ids[k : k + 4 * block_ids], bits):
            parts.append(compress(plane))
            at += len(parts[-1])
            index.append(at)
    return b"".join(parts), index


def unpack(payload: bytes, index: list[int], n_ids: int, block_ids: int = BLOCK_IDS, bits: bool = False) -> bytes:
    """The chunk's ids from its payload, read plane by plane through the index."""
    import zstandard

    expand, n_planes, view, out = zstandard.ZstdDecompressor().decompress, 32 if bits else 4, memoryview(payload), []
    for b, first in enumerate(range(0, n_ids, block_ids)):
        at = index[b * n_planes : (b + 1) * n_planes + 1]
        planes = [expand(view[x:y]) for x, y in zip(at, at[1:])]
        out.append(ids_of(planes, min(block_ids, n_ids - first)))
    return b"".join(out)


_CHUNK = "shard int, seq int, shard_start bigint, n_ids bigint, block_ids int, bits boolean, doc_ids array<{id}>, lengths array<bigint>, plane_index array<bigint>, payload binary"


def write_planes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, bits: bool = False, level: int = LEVEL) -> None:
    """Encode docs and write the chunks to path (Parquet). One shuffle: texts to ranges of ids.

    A chunk ends with the document that fills it to chunk_ids, so memory is bounded by that and the longest document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = _CHUNK.format(id=base.schema["doc_id"].dataType.simpleString())
    out = arrow_schema(spark, schema)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = shared_encoder(tokenizer), TaskContext.get().partitionId()
        seq = done = held = 0
        doc_ids, parts = [], []

        def chunk():
            ids = b"".join(parts)
            payload, index = pack(ids, block_ids, bits, level)
            row = [shard, seq, done, len(ids) // 4, block_ids, bits, list(doc_ids), [len(p) // 4 for p in parts], index, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for docs, texts in gathered(batches):
            for doc, ids in zip(docs.to_pylist(), encoder.encode(texts, end), strict=True):
                doc_ids.append(doc)
                parts.append(ids)
                held += len(ids) // 4
                if held >= chunk_ids:
                    yield chunk()
                    seq, done, held = seq + 1, done + held, 0
                    doc_ids.clear(), parts.clear()
        if parts:
            yield chunk()

    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = base.repartitionByRange(buckets_for(spark, text_bytes(base)), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(encode, schema).write.option("compression", "none").parquet(path)


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHER_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of several batches together: the more text at once, the fewer distinct words to look up."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
            held = []
    if held:
        yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))


_ENCODERS: dict[str, Encoder | WholeTexts] = {}


def shared_encoder(path: str) -> Encoder | WholeTexts:
    """One encoder a worker process, so that its memo serves all its tasks."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as file:
            _ENCODERS[path] = Encoder(path) if by_words(json.load(file)) else WholeTexts(path)
    return _ENCODERS[path]


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, ids (little-endian 32-bit).

    Shard totals are summed to offsets; they are one row a shard, far below any broadcast bound.
    """
    chunks = spark.read.parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    schema = f"doc_id {chunks.schema['doc_ids'].dataType.elementType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    out = arrow_schema(spark, schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids = unpack(row["payload"], row["plane_index"], row["n_ids"], row["block_ids"], row["bits"])
                ends = np.cumsum(row["lengths"])
                cut = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends, row["lengths"], strict=True)]
                starts = row["offset"] + row["shard_start"] + ends - np.array(row["lengths"])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((row["doc_ids"], starts, row["lengths"], [zlib.crc32(c) for c in cut], cut), out, strict=True)], schema=out)

    small_batches(spark)
    return chunks.join(F.broadcast(offsets), "shard").mapInArrow(decode, schema)


def encode_corpus(docs: DataFrame, **options) -> DataFrame:
    """Write docs' ids to a new folder of the shared one, and return what read_planes reads there."""
    path = fresh_path(docs.sparkSession, "token-planes")
    write_planes(docs, path, **options)
    return read_planes(docs.sparkSession, path)


def op2_token_planes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_corpus(docs).select("doc_id", "start", "n_tokens", "ids_crc32")
