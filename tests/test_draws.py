"""Draws of a bootstrap meet the sums of their own series; they are many times more than these and are never broadcast."""

import pytest
from pyspark.sql import functions as F

from lacunae.operators import bootstrap


@pytest.fixture(scope="module")
def sums(spark):
    rows = [(s, b, 1 + b % 3, float(1 + b % 7), float(2 + b % 5), int(b % 4 == 0), float(1 + b % 3), float(b % 4 == 0)) for s, n in (("a", 30), ("b", 7), ("c", 1)) for b in range(n)]
    return spark.createDataFrame(rows, "series_id string, block bigint, n_c bigint, m_c double, p_c double, n_a bigint, m_a double, p_a double").cache()


def broadcast_draws(df) -> bool:
    """Whether a broadcast lies over rows that were exploded."""
    df.collect()  # the plan that was run in the end
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            end = next((j for j, other in enumerate(below) if depth(other) <= depth(line)), len(below))
            if any("Generate explode" in other for other in below[:end]):
                return True
    return False


def test_draws_are_not_broadcast(sums):
    assert not broadcast_draws(bootstrap.bias_of_blocks(sums, 20, 7))


def test_series_too_long_to_be_held(sums, monkeypatch):
    scored = sums.select("series_id", F.col("block").alias("t"), "m_c")
    def intervals():
        made = (bootstrap.bias_of_blocks(sums, 40, 7, redraws=5), bootstrap.circular_rmse_interval(scored, F.col("m_c"), 4, 40, 7), bootstrap.iid_mean_interval(scored, "m_c", 40, 7, ["series_id"]))
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in made]

    whole = intervals()
    monkeypatch.setattr(bootstrap, "HELD", 10)
    assert whole == intervals() and [len(x) for x in whole] == [3, 3, 3]


def test_few_replicates_a_row(sums, monkeypatch):
    want = sorted(map(tuple, bootstrap.bias_of_blocks(sums, 40, 7).collect()), key=str)
    monkeypatch.setattr(bootstrap, "CHUNK", 16)
    assert sorted(map(tuple, bootstrap.bias_of_blocks(sums, 40, 7).collect()), key=str) == want


def test_replicates_of_days_are_not_shuffled(spark):
    rows = [(s, day, float(day + k)) for s in ("a", "b", "c") for day in range(5) for k in range(3)]
    df = spark.createDataFrame(rows, "series_id string, cluster bigint, x double")
    w = bootstrap.cluster_weights(df.withColumn("all", F.lit(0)), 40, 7, ["all"])
    few, many = (bootstrap.cluster_mean_interval(df, "x", w, ["series_id"], few=f) for f in (True, False))
    assert sorted(few.collect()) == sorted(many.collect())
    plan = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = plan[: plan.rindex("Generate explode(_drawn")]
    assert "Exchange" not in above
