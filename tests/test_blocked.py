"""Plans for long series against plain windows over the whole series, and that several tasks work on one series."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacunae.operators import blocked, features, grid, hac, origins, scores, segments

STEP = 600
K, OWN = ["series_id"], ["series_id", "seg"]


@pytest.fixture(scope="module")
def long(spark):
    """Series a of 6,000 places with gaps, b short, one without a name, and one of a single row."""
    rng = np.random.default_rng(1)
    rows = [("a", k * STEP, float(x)) for k, x in enumerate(rng.normal(8, 2, 6000)) if not 100 <= k < 103 and not 2000 <= k < 3500 and k % 701]
    rows += [("b", k * STEP, float(k % 9)) for k in range(50)] + [(None, k * STEP, 1.0 + k) for k in range(0, 30, 2)] + [("d", 0, 1.0)]
    return spark.createDataFrame(rows, "series_id string, t bigint, v double").repartition(4).cache()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("span", [STEP, 40_000, 1 << 20])
def test_numbers_and_segments(long, span):
    order = Window.partitionBy("series_id").orderBy("t")
    plain = long.withColumn("_r", F.row_number().over(order) - 1).withColumn("_c", F.count("*").over(Window.partitionBy("series_id")))
    assert rows_of(blocked.numbered(long, K, span), "series_id", "t", "_r", "_c") == rows_of(plain, "series_id", "t", "_r", "_c")
    cut = F.coalesce((F.col("t") - F.lag("t").over(order) != STEP).cast("int"), F.lit(0))
    plain = long.withColumn("b", cut).withColumn("seg", F.sum("b").over(order))
    assert rows_of(segments.segment_ids(long, STEP, span=span), "series_id", "t", "seg") == rows_of(plain, "series_id", "t", "seg")


@pytest.mark.parametrize("span", [STEP, 40_000, 1 << 20])
def test_fills(long, span):
    whole = grid.reindex(long, STEP).cache()
    got = rows_of(grid.fill_short_gaps(whole, 3, span=span), "series_id", "t", "v", "filled")
    assert got == rows_of(grid.fill_short_gaps(whole, 3, span=1 << 40), "series_id", "t", "v", "filled")
    assert sum(f for *_, f in got) > 8 and not any(f and v is None for _, _, v, f in got)


def test_halo(long):
    placed = blocked.numbered(long)
    halo = blocked.with_halo(placed, 5, 3, 64)
    own = ["series_id", "_blk"]
    order = Window.partitionBy(*own).orderBy("t")
    got = halo.withColumn("m", F.sum("v").over(order.rowsBetween(-5, 3))).where("_own")
    plain = long.withColumn("m", F.sum("v").over(Window.partitionBy("series_id").orderBy("t").rowsBetween(-5, 3)))
    assert [(a, b, round(c, 9)) for a, b, c in rows_of(got, "series_id", "t", "m")] == [(a, b, round(c, 9)) for a, b, c in rows_of(plain, "series_id", "t", "m")]
    assert got.where("series_id = 'a'").select("_blk").distinct().count() > 60


def test_kalman_of_a_long_series_by_blocks(spark, long):
    back, rows = features.kalman_reach()
    for df, keys in ((long.where("series_id is not null"), K), (segments.segment_ids(long, STEP).where("series_id is not null"), OWN)):
        assert keys == OWN or long.where("series_id = 'a'").count() > rows + back  # more than one block
        want, state = {}, {}
        for r in sorted(df.collect(), key=lambda r: r.t):
            key = tuple(r[k] for k in keys)
            x, p = state.get(key, (None, 1.0))
            if x is None:
                state[key] = (r.v, 1.0)
            else:
                m = p + 0.02
                k = m / (m + 0.6)
                state[key] = (x + k * (r.v - x), (1 - k) * m)
            want[r.series_id, r.t] = state[key][0]
        got = {(r.series_id, r.t): r.kalman for r in features.kalman_level_blocked(df, keys).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_one_long_series_is_not_one_task(spark, long):
    """Rows of the one long series are in several partitions wherever they are ordered."""
    placed = blocked.numbered(long.where("series_id = 'a'"), K, 100 * STEP)
    dealt = blocked.with_halo(placed, 5, 1, 128).repartition(8, "series_id", "_blk")
    tasks = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 4


def bartlett(c, lag):
    n = len(c)
    c = c - c.mean()
    s = c @ c + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) for k in range(1, lag + 1))
    return s / n / n


def test_kernel_of_any_lag(spark, monkeypatch):
    """A horizon of 90 asks for 89 lags, and n - 1 bounds them."""
    rng = np.random.default_rng(2)
    x = np.convolve(rng.normal(size=900), np.ones(30), "valid")
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("b", k, float(v)) for k, v in enumerate(x[:20])] + [("b", 99, None)], "series_id string, t bigint, v double")
    for h, lags in ((1, (10, 10)), (90, (89, 19))):
        got = {r.series_id: r for r in hac.hac_mean(df, F.col("v"), h).collect()}
        for name, part, lag in zip("ab", (x, x[:20]), lags, strict=True):
            assert got[name].n == len(part) and got[name].mean == pytest.approx(part.mean())
            assert got[name].variance == pytest.approx(max(1e-12, bartlett(part, lag)), rel=1e-9)


def test_p_values():
    assert hac.p_of(1.959963985, 100, "two-sided") == pytest.approx(0.05, abs=1e-9)
    assert hac.p_of(1.644853627, 100, "greater") == pytest.approx(0.05, abs=1e-9)
    assert hac.p_of(2.228138852, 11, "dm") == pytest.approx(0.05, abs=1e-9)
    assert hac.p_of(0.5760, 12, "correlation") == pytest.approx(0.05, abs=1e-4)
    assert hac.p_of(None, 5, "dm") is None and hac.p_of(1.0, 9, "correlation") == 0


def test_both_designs_equal_the_operators_one_by_one(long):
    seg = segments.segment_ids(long.where("series_id is not null"), STEP)
    made = features.both_designs(seg, 15, 12, 2)
    for mark, keys in (("a_", OWN), ("n_", K)):
        plain = features.build_features(seg, 15, keys)
        names = features.feature_names(15)
        joined = made.join(plain.select("series_id", "t", *[F.col(n).alias("p_" + n) for n in names]), ["series_id", "t"])
        off = [F.count(F.when(F.abs(F.col(mark + n) - F.col("p_" + n)) > 1e-9, 1)) + F.count(F.when(F.col(mark + n).isNull() != F.col("p_" + n).isNull(), 1)) for n in names]
        if mark == "n_":
            assert set(joined.agg(*off).first()) == {0}
        else:
            assert set(joined.where("valid").agg(*off).first()) == {0}
    valid = origins.valid_origins(seg, 15, 12, 2)
    assert rows_of(made.where("valid"), "series_id", "t", "target_t") == rows_of(valid, "series_id", "t", "target_t")
    split = origins.both_splits(made, 12, 2, least=100, least_test=20)
    aware = origins.gap_aware_split(valid, 12, 2, least=100, least_test=20)
    assert rows_of(split.where("split_a is not null"), "series_id", "t", "split_a") == rows_of(aware.where("split is not null"), "series_id", "t", "split")
    naive = origins.calendar_split(features.with_target(long.where("series_id is not null"), 2), origins.bounds_of(aware))
    assert rows_of(split.where("split_c is not null"), "series_id", "t", "split_c") == rows_of(naive.where("split is not null"), "series_id", "t", "split")
    rows, keys = scores.arm_rows(split, ["a_kalman"], ["n_kalman"]), [*K, "arm"]
    one = scores.arm_skills(scores.predict_ridge1(rows.where("role = 'test'"), scores.fit_ridge1(rows.where("role = 'train'"), "x0", keys=keys), "x0", keys)).first()
    level = lambda df, keys, name: features.kalman_level_blocked(df, keys).select("series_id", "t", F.col("kalman").alias(name))
    a, n = level(seg, OWN, "ka"), level(seg, K, "kn")
    two = scores.four_arms(aware.join(a, ["series_id", "t"]).join(n, ["series_id", "t"]), naive.join(n, ["series_id", "t"]), "ka", "kn").first()
    for c in ("skill_a", "skill_b", "skill_c", "skill_d", "n_a", "n_c", "n_d", "total"):
        assert one[c] == pytest.approx(two[c])
