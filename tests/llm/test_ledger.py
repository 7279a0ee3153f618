"""A ledger that holds a pair twice; paths and versions; a second run scans only what is new."""

from lacunae.llm import secret_ledger as sl
from lacunae.llm.common import fresh_path

HISTORY = [("a.txt", 1, "token=abcdef1"), ("a.txt", 2, "token=abcdef2"), ("b.txt", 1, "token=abcdef1"), ("b.txt", 2, None), ("c.txt", 1, "")]


def test_pairs_in_the_ledger_twice(spark):
    ledger = fresh_path(spark, "t")
    docs = spark.createDataFrame([(1, "password: hunter22"), (2, "nothing")], "doc_id bigint, text string")
    sl.find_secrets(docs, ledger)
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-twice")
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-twice")
    assert sorted(r.doc_id for r in sl.find_secrets(docs, ledger + "-twice").collect()) == [1, 2]


def test_paths_and_versions(spark):
    ledger = fresh_path(spark, "t")
    history = spark.createDataFrame(HISTORY, "path string, version int, text string")
    sl.find_secrets(history.where("version = 1"), ledger, paths=("path", "version"))
    assert spark.read.parquet(ledger).count() == 2
    got = sl.find_secrets(history, ledger, paths=("path", "version"))
    assert spark.read.parquet(ledger).count() == 3  # the one new blob
    assert {(r.path, r.version, tuple(r.starts)) for r in got.collect()} == {(p, v, (0,) if t else ()) for p, v, t in HISTORY}
