"""The packed exchange: buckets one to one, and two steps with long rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacunae.llm import packed_exchange as pe
from lacunae.llm import simhash_pivots as sp
from lacunae.llm import substring_dedup as sd
from lacunae.llm.common import mix64


def keys(n, seed=0):
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32))


def test_no_task_gets_two_buckets(spark):
    rows = spark.createDataFrame([(0, b, None, b"x" * 8, None, None, None, None) for b in range(200)], pe.SCHEMA)
    got = pe.exchange(rows, 200).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("bucket").alias("n")).collect()
    assert len(got) == 200 and {r.n for r in got} == {1}


def test_rows_stay_long_with_many_buckets():
    a = keys(1 << 20)
    rows = list(pe.bucket_rows(100_000, a, None, a.view(np.int64), None, None))
    assert len(rows) == pe.FAN and min(len(r[3]) for r in rows) > 8 * 128


def test_two_steps(spark, monkeypatch):
    monkeypatch.setattr(pe, "FAN", 8)
    n_buckets, a = 50, keys(5000)

    def ship(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                own = a[k * 1000 : (k + 1) * 1000]
                yield pe.batch_of([*pe.bucket_rows(n_buckets, own, None, own.view(np.int64), None, None), *pe.owner_rows(n_buckets, own[:300].view(np.int64), own[:300])])

    def count(batches):
        for held in pe.each_bucket(batches):
            number = held[0].column("bucket")[0].as_py()
            x, y = pe.Gathered({"a": np.uint64, "docs": np.uint64}, held).arrays()
            assert (x == y).all() and (pe.bucket_of(x, n_buckets) == number).all()
            docs, found = pe.Gathered({"docs": np.int64, "pos": np.uint64}, held, 1).arrays()
            assert (docs.view(np.uint64) == found).all() and (pe.bucket_of(mix64(found), n_buckets) == number).all()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(x)]), pa.array([len(docs)])], names=["bucket", "n", "m"])

    got = pe.exchange(spark.range(5).repartition(3).mapInArrow(ship, pe.SCHEMA), n_buckets).mapInArrow(count, "bucket bigint, n bigint, m bigint").collect()
    assert len({r.bucket for r in got}) == len(got) == n_buckets and sum(r.n for r in got) == 5000 and sum(r.m for r in got) == 1500


@pytest.mark.parametrize("fan", [3])
def test_operators_over_two_steps(spark, monkeypatch, fan):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50 if k % 5 else j}" for j in range(40))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    key = lambda r: tuple(r)
    before = sorted(map(key, sd.remove_repeats(docs).collect())), sorted(map(key, sp.near_duplicates(docs).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(pe, "FAN", fan)
    assert before == (sorted(map(key, sd.remove_repeats(docs).collect())), sorted(map(key, sp.near_duplicates(docs).select("doc_id", "component_id").collect())))
