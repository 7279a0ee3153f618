"""Operators that deal a long series over tasks, against the same by windows over the whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacunae.operators import blocked, bootstrap, grid, hac, profile, ranks, segments


def along():
    return Window.partitionBy("series_id").orderBy("t")



@pytest.fixture(scope="module")
def gappy(spark):
    rng = random.Random(1)
    rows = []
    for s in ("a", "b", None):
        t = -3000
        for _ in range(400):
            t += 10 * rng.choice([1, 1, 1, 1, 1, 1, 2, 5, 30])
            rows.append((s, t, float(rng.randrange(9)) if rng.random() < 0.8 else None))
    rows += [("one", 5, 1.0)]
    return spark.createDataFrame(rows, "series_id string, t bigint, v double").cache()


@pytest.mark.parametrize("span", [7, 100, 10**6])
def test_placed(gappy, span):
    own = Window.partitionBy("series_id", "seg").orderBy("t")
    want = segments.segment_ids(gappy, 10).withColumns({"_r": F.row_number().over(along()) - 1, "_c": F.count("*").over(Window.partitionBy("series_id")), "_p": F.row_number().over(own) - 1, "_n": F.count("*").over(Window.partitionBy("series_id", "seg"))})
    names = ["series_id", "t", "v", "seg", "_r", "_c", "_p", "_n"]
    key = lambda df: sorted(map(str, df.select(names).collect()))
    assert key(blocked.placed(gappy, 10, span=span)) == key(want)


@pytest.mark.parametrize("span", [7, 100, 10**6])
def test_nearest_and_fills(gappy, span):
    marked = gappy.withColumn("x", F.when(F.pmod("t", F.lit(70)) == 0, F.col("t")))
    want = marked.withColumns({"_before": F.last("x", True).over(along().rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("x", True).over(along().rowsBetween(0, Window.unboundedFollowing))})
    key = lambda df: sorted(map(str, df.select("series_id", "t", "x", "_before", "_after").collect()))
    assert key(blocked.nearest(marked, "x", span=span)) == key(want)
    full = grid.reindex(gappy.where("series_id is not null and v is not null"), 10)
    whole, parts = (sorted(map(str, grid.fill_short_gaps(full, 3, span=s).collect())) for s in (10**9, span))
    assert whole == parts
    starts = gappy.where("pmod(t, 130) = 0").select("series_id", "t")
    far = {(r.series_id, r.t) for r in profile.far_from_gap_starts(gappy, starts, 2, 10, span=span).collect()}
    at = [(r.series_id, r.t) for r in starts.collect()]
    assert far == {(r.series_id, r.t) for r in gappy.collect() if not any(s == r.series_id and abs(t - r.t) <= 20 for s, t in at)}


def test_no_frame_reaches_to_the_end(spark, gappy, capsys):
    full = grid.reindex(gappy.where("v is not null"), 10)
    grid.fill_short_gaps(full, 3).explain()
    profile.far_from_gap_starts(gappy, gappy, 2, 10).explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower().replace(" ", "").replace("specifiedwindowframe(rowframe,unboundedpreceding$(),unboundedfollowing$())", "")


def test_ranks_and_percentiles(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("series_id"), F.when(F.rand(1) < 0.9, F.floor(F.rand(2) * F.when(F.col("id") % 3 == 0, 20).otherwise(1e6)).cast("double")).alias("v"), F.col("id").alias("t")).cache()
    got = ranks.average_ranks(df, "v", "r", ties="n", tasks=7)
    ties = F.count("*").over(Window.partitionBy("series_id", "v"))
    want = df.where("v is not null").withColumn("n", ties).withColumn("r", F.rank().over(Window.partitionBy("series_id").orderBy("v")) + (F.col("n") - 1) / 2)
    key = lambda d: sorted(map(str, d.select("series_id", "t", "r", "n").collect()))
    assert key(got) == key(want)
    wanted = {"a": 0.05, "b": 0.5, "c": 1.0, "d": 0.0, "e": 0.951}
    found = {r.series_id: r for r in ranks.percentiles(df, "v", wanted, tasks=7).collect()}
    for r in df.groupBy("series_id").agg(*[F.percentile("v", q).alias(n) for n, q in wanted.items()]).collect():
        assert [found[r.series_id][n] for n in wanted] == pytest.approx([r[n] for n in wanted])
    dealt, _ = ranks.ranged(df.where("series_id = 's1'"), "v", tasks=7)
    assert dealt.select("_part").distinct().count() == 7  # one series, several tasks
    assert ranks.percentiles(df.where("false"), "v", {"m": 0.5}).count() == 0


def test_tests_and_bootstraps_of_a_split_series(spark):
    df = spark.range(3000).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.rand(4).alias("v"), (F.col("id") % 7 == 0).alias("g"), F.floor(F.col("id") / 40).alias("seg"))
    u = hac.mann_whitney(df, F.col("g"), "v").first()
    rows = df.orderBy("v").collect()
    s = sum(k + 1 for k, r in enumerate(rows) if r.g)
    assert u.u == s - u.n1 * (u.n1 + 1) / 2 and u.n1 == sum(r.g for r in rows)
    blocks = bootstrap.segment_blocks(df, 25).orderBy("t").collect()
    assert [r.block for r in blocks[:41]] == [0] * 25 + [1] * 15 + [2] and blocks[-1].block == 149
    mean = bootstrap.iid_mean_interval(df, "v", 50, 3, ["series_id"]).first()
    assert mean.ci_lo < 0.5 + 0.03 and mean.ci_hi > 0.5 - 0.03 and mean.n_reps == 50


def test_label_changes_by_blocks(gappy):
    rows = gappy.where("series_id is not null and v is not null").select("series_id", "t", F.when(F.col("v") < 5, "x").otherwise("y").alias("label"))
    key = lambda span: sorted(map(tuple, segments.label_changes(rows, "label", span=span).collect()))
    assert key(700) == key(10**9)
