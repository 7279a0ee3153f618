"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch: texts may be long, so batches stay small. Narrow rows reach the session's own row bound first.
BATCH_BYTES = 1 << 20
#: Bytes that one bucket of a shuffle held in Python may have.
BUCKET_BYTES = 64 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode a fresh local one may take its place (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that Python workers' memory stays bounded. Batches of narrow rows are no smaller for it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < byte_size(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def byte_size(text: str) -> int:
    """Bytes of a size as Spark writes it: a number, maybe with k, m or g."""
    number, unit = re.match(r"(-?\d+)\s*([kmg]?)", text.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    name, taken = f"_{stem}", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def hashable(docs: DataFrame) -> list:
    """The columns that xxhash64 takes; maps go as their sorted entries."""
    return [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "variant"]


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets to deal n_bytes into: as many as the session has shuffle partitions, more where a bucket would pass bucket_bytes."""
    return max(partitions(spark), -(-n_bytes // bucket_bytes))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, by one aggregate over that column."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null read as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_texts(docs: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Apply make()'s function to every Arrow batch of the chosen columns. It returns a dict of columns of the schema.

    make() runs once a task, so that it can open tokenizers or build tables.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                got = work(batch)
                yield pa.RecordBatch.from_arrays([as_array(got[f.name], f.type) for f in out], schema=out)

    return docs.select(*columns).mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def held_out(id_column: str, modulus: int, remainder: int):
    """Whether crc32(id as text) mod modulus is the remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift and multiply), so that any bits serve as hash bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A dict that computes what it misses, and empties itself at a bound, so that memory stays bounded."""

    def __init__(self, compute: Callable, most: int = 400_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value
