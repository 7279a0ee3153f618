"""Intervals with the reference's numbers of replicates; unusable replicates are drawn again."""

from pathlib import Path

import duckdb
import pytest

from lacunae.operators import bootstrap
from lacunae.registry import REGISTRY

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize(("name", "reps"), [("circular_bootstrap", 500), ("cluster_bootstrap", 2000)])
def test_full_replicates(spark, name, reps):
    query, sql = REGISTRY[f"{name}_full"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    want = con.sql(sql)
    got = query(spark, str(FOLDER)).select(want.columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))
    assert got and {r["n_reps"] for r in got} == {reps}


def test_unusable_replicates_are_drawn_again(spark):
    rows = [("s", t, float(1 + t % 7), float(2 + t % 5), t // 10) for t in range(60)]
    blocks = spark.createDataFrame(rows, "series_id string, t bigint, em2 double, ep2 double, block bigint")
    arm = blocks.drop("block")
    few = arm.where("t < 10")  # in one block of six: about a third of the replicates lack it
    once = bootstrap.bias_interval(few, arm, blocks, 40, 1).first()
    again = bootstrap.bias_interval(few, arm, blocks, 40, 1, redraws=5).first()
    assert once.n_reps < 40 and again.n_reps == 40 and again.ci_lo < again.ci_hi
    none = bootstrap.bias_interval(few, arm, blocks, 40, 1, share=3.0, redraws=5).collect()
    assert all(r.n_reps >= 20 or r.ci_lo is None for r in none)
