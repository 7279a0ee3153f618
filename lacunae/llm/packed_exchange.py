"""Exchange of (key, document) pairs in packed blocks.

Finding what repeats among documents means grouping billions of small pairs by a hash. Here a task sorts its pairs, combines
what it can decide itself, and ships the rest as a few rows of packed arrays for each bucket of keys; a row of the shuffle
holds thousands of pairs. The combine keeps hot keys harmless: however many documents share a key, a task ships one pair for it.

A bucket is what is held in Python at once. Rows go to partitions by their bucket's number itself, so no task gets two buckets of an exchange
of up to FAN. More buckets are dealt in two steps: rows for FAN coarse ones (long rows, as there are few), which a task then
cuts into its own fine buckets and has Spark sort by them, on disk if need be; they are decided one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64

#: Pairs that a task gathers before it sorts and ships them.
FLUSH_PAIRS = 1 << 20
#: Most partitions of an exchange.
FAN = 4096

#: kind 1: packed findings of a bucket of documents; other kinds: packed keys of a bucket.
SCHEMA = "kind int, bucket int, doc_id bigint, a binary, b binary, docs binary, pos binary, many binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
ARROW = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], schema=ARROW)


def bucket_of(a: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each mixed hash, by its upper half."""
    return ((a >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def packed(bucket: np.ndarray, *columns: np.ndarray | None) -> Iterator[tuple[int, list[bytes | None]]]:
    """Each bucket that occurs, with its part of the columns."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(group_starts(bucket))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=False):
        at = order[s:e]
        yield int(bucket[s]), [None if x is None else x[at].tobytes() for x in columns]


def bucket_rows(n_buckets: int, a: np.ndarray, *others: np.ndarray | None, kind: int = 0) -> Iterator[tuple]:
    """Rows for pairs in any order; a is a mixed hash, which chooses the bucket."""
    for k, (own, *rest) in packed((bucket_of(a, n_buckets) % FAN).astype(np.uint16), a, *others):
        yield (kind, k, None, own, *rest)


def exchange(rows: DataFrame, n_buckets: int) -> DataFrame:
    """The rows by buckets: each_bucket gives those of each."""
    if n_buckets <= FAN:
        return rows.repartitionById(n_buckets, "bucket")
    return rows.repartitionById(FAN, "bucket").mapInArrow(lambda batches: finer(batches, n_buckets), SCHEMA).sortWithinPartitions("bucket")


def finer(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of coarse buckets as rows of fine ones. Rows without packed keys have their fine bucket already."""
    held: dict[tuple, list[tuple]] = {}
    size = 0

    def cut():
        out = []
        for (kind, doc_id, _), rows in held.items():
            columns = [None if x[0] is None else b"".join(x) for x in zip(*rows, strict=True)]
            keys = np.frombuffer(columns[2 if kind == 1 else 0], np.uint64)
            wide = [None if x is None else np.frombuffer(x, f"V{len(x) // len(keys)}") for x in columns]
            out += [(kind, k, doc_id, *own) for k, own in packed(bucket_of(mix64(keys) if kind == 1 else keys, n_buckets), *wide)]
        held.clear()
        return batch_of(out)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            kind, bucket, doc_id, *columns = row
            if kind == STORE:
                yield batch_of([row])
            elif columns[2 if kind == 1 else 0]:
                held.setdefault((kind, doc_id, tuple(x is None for x in columns)), []).append(columns)
                size += sum(len(x) for x in columns if x)
                if size >= FLUSH_PAIRS * 16:
                    yield cut()
                    size = 0
    if held:
        yield cut()


#: The kind of rows that exchange() leaves as they are: their bucket is given, not told by keys.
STORE = 9


def each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Of one task's rows in the order of their buckets: those of each."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and number[s] != now:
                yield held
                held = []
            now = number[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield held


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: whether a row begins a new group."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def per_group(ufunc: np.ufunc, values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The ufunc over each group, given back to each of its rows."""
    return ufunc.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1] if len(values) else values


def owner_rows(n_buckets: int, docs: np.ndarray, found: np.ndarray) -> Iterator[tuple]:
    """Rows of kind 1: findings (one for each entry of docs) packed for each bucket of documents."""
    for k, (own, what) in packed((bucket_of(mix64(docs.view(np.uint64)), n_buckets) % FAN).astype(np.uint16), docs, found):
        yield (1, k, None, None, None, own, what, None)


def of_kind(batch: pa.RecordBatch, kind: int) -> np.ndarray:
    """Places of the batch's rows of this kind."""
    return np.flatnonzero(batch.column("kind").to_numpy(zero_copy_only=False) == kind)


def by_owner(batches: Iterator[pa.RecordBatch], dtype: type) -> Iterator[tuple[int, np.ndarray]]:
    """Of one task's rows of kind 1: each document and its sorted distinct findings."""
    for held in each_bucket(batches):
        docs, found = Gathered({"docs": np.int64, "pos": dtype}, held, 1).arrays()
        order = np.lexsort((found, docs))
        docs, found = docs[order], found[order]
        keep = group_starts(docs, found)
        docs, found = docs[keep], found[keep]
        starts = np.flatnonzero(group_starts(docs))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(docs)], strict=False):
            yield int(docs[s]), found[s:e]


class Gathered:
    """Packed columns of one bucket's rows of a kind."""

    def __init__(self, dtypes: dict[str, type], batches: list[pa.RecordBatch], kind: int = 0):
        self.dtypes, self.parts = dtypes, {k: [] for k in dtypes}
        for batch in batches:
            for k in of_kind(batch, kind).tolist():
                for name, dtype in dtypes.items():
                    self.parts[name].append(np.frombuffer(batch.column(name)[k].as_py(), dtype))

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(p) if p else np.empty(0, self.dtypes[n]) for n, p in self.parts.items()]
