"""The series operators on synthetic series, against numpy and the properties they must have."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunae.functions import special
from lacunae.operators import bootstrap, features, grid, hac, inject, models, origins, profile, scores, segments, summary

STEP = 600
K, OWN = ["series_id"], ["series_id", "seg"]


def ar1(n, gaps=(), seed=0):
    """Times and values of an AR(1) series on a 10-minute grid with stretches taken out."""
    rng = np.random.default_rng(seed)
    v = np.empty(n)
    v[0] = 8
    for k in range(1, n):
        v[k] = 8 + 0.9 * (v[k - 1] - 8) + rng.normal(0, 0.5)
    gone = {k for a, m in gaps for k in range(a, a + m)}
    return [(k * STEP, float(v[k])) for k in range(n) if k not in gone]


def frame(spark, rows, name="x"):
    return spark.createDataFrame([(name, t, v) for t, v in rows], "series_id string, t bigint, v double")


@pytest.fixture(scope="module")
def gappy(spark):
    return frame(spark, ar1(600, [(100, 5), (300, 20)])).cache()


@pytest.fixture(scope="module")
def whole(spark):
    return frame(spark, ar1(1500)).cache()


def by_time(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("t").collect()]


def test_segments(gappy):
    seg = segments.segment_ids(gappy, STEP)
    ids = [s for (s,) in by_time(seg, "seg")]
    assert ids == sorted(ids) and set(ids) == {0, 1, 2}
    assert by_time(segments.segment_ids_blocked(gappy, STEP, block=7000), "t", "seg") == by_time(seg, "t", "seg")
    assert sum(r.length for r in segments.segment_lengths(seg).collect()) == gappy.count()


def test_shorter_step_also_cuts(spark):
    df = frame(spark, [(0, 1.0), (600, 1.0), (900, 1.0), (1500, 1.0)])
    assert by_time(segments.segment_ids(df, STEP), "seg") == [(0,), (0,), (1,), (1,)]
    assert by_time(segments.segment_ids_blocked(df, STEP, block=1000), "seg") == [(0,), (0,), (1,), (1,)]


def test_features_stay_within_segments(gappy):
    f = features.build_features(segments.segment_ids(gappy, STEP), 60, OWN)
    starts = f.groupBy("seg").agg(F.min("t").alias("t")).join(f, ["seg", "t"]).collect()
    assert len(starts) == 3 and all(r.lag_1 is None and r.roll_mean_5 is None and r.kalman == r.v for r in starts)


def test_features_against_numpy(whole):
    rows = whole.orderBy("t").collect()
    v = np.array([r.v for r in rows])
    names = features.feature_names()
    got = {r.t: r for r in features.build_features(whole, 60, K).collect()}
    assert len(names) == 19
    x, p, level = v[0], 1.0, [v[0]]
    for z in v[1:]:
        m = p + 0.02
        k = m / (m + 0.6)
        x, p = x + k * (z - x), (1 - k) * m
        level.append(x)
    for i in (59, 60, 700, 1499):
        r = got[rows[i].t]
        assert r.roll_mean_15 == pytest.approx(v[i - 14 : i + 1].mean()) and r.roll_std_60 == pytest.approx(v[i - 59 : i + 1].std(ddof=1))
        assert r.turbulence == pytest.approx(v[i - 29 : i + 1].std(ddof=1) / (v[i - 29 : i + 1].mean() + 1e-9))
        assert r.kalman == pytest.approx(level[i], abs=1e-12) and r.lag_30 == v[i - 30] and r.shear == v[i] - v[i - 1]
        assert (r.lag_60 is None) == (i < 60)


def test_features_are_causal(gappy):
    seg = segments.segment_ids(gappy, STEP)
    checks = features.causality_checks(seg, lambda d, keys: features.build_features(d, 15, keys), features.feature_names(15)).collect()
    assert len(checks) > 5 and not any(r.wrong for r in checks)


def test_origins_never_cross_a_gap(gappy):
    seg = segments.segment_ids(gappy, STEP)
    at = dict(by_time(seg, "t", "seg"))
    valid = origins.valid_origins(seg, 20, 36, 6).collect()
    assert valid
    for r in valid:
        assert at[r.t] == at[r.t + 6 * STEP] == at[r.t - 35 * STEP] and r.target_t == r.t + 6 * STEP
    formula = segments.retention(segments.segment_lengths(seg), F.lit(35), F.lit(6)).first()
    assert formula.n_valid == len(valid)


def test_without_gaps_both_kinds_agree(whole):
    a = features.build_features(segments.segment_ids(whole, STEP), 60, OWN)
    d = features.feature_differences(features.build_features(whole, 60, K), a, features.feature_names()).first()
    assert d.n_differ == 0 and d.n_rows == 1440 and d.max_kalman == 0


def test_naive_target_jumps_gaps(gappy):
    lead = [t2 - t for t, t2 in by_time(features.with_target(gappy, 1).where("target is not null"), "t", "target_t")]
    assert min(lead) == STEP and max(lead) == 21 * STEP
    moved = features.with_target(gappy, 1).where(features.displaced(1, STEP)).count()
    assert moved == 2


def test_short_gaps_are_filled(spark):
    values = [None if k in (3, 4) or 10 <= k <= 15 else float(k) for k in range(20)]
    df = spark.createDataFrame([("x", k * STEP, v) for k, v in enumerate(values)], "series_id string, t bigint, v double")
    got = by_time(grid.fill_short_gaps(df, 3), "v", "filled")
    assert [v for v, _ in got] == [float(k) if k in (3, 4) else values[k] for k in range(20)]
    assert sum(f for _, f in got) == 2
    edge = spark.createDataFrame([("x", 0, None), ("x", 600, 1.0), ("x", 1200, None)], "series_id string, t bigint, v double")
    assert [v for v, _ in by_time(grid.fill_short_gaps(edge, 3), "v", "filled")] == [None, 1.0, None]
    audit = grid.interpolation_audit(df, 3).first()
    assert (audit.observed, audit.filled) == (12, 2)


def test_grid(spark, gappy):
    assert grid.reindex(gappy, STEP, block=64).count() == 600
    df = frame(spark, [(299, 1.0), (300, 2.0), (301, 3.0), (900, 4.0)])
    assert Counter(t for (t,) in by_time(grid.snap_to_grid(df, STEP), "t")) == Counter([0, 0, 600, 1200])
    twice = spark.createDataFrame([("x", 0, None, 1), ("x", 0, 5.0, 2), ("x", 0, 6.0, 3)], "series_id string, t bigint, v double, line int")
    assert grid.dedupe_first(twice, ["line"]).first().v is None and grid.dedupe_prefer_valid(twice, ["line"]).first().v == 5.0
    report = segments.gap_report(grid.reindex(gappy, STEP), STEP).first()
    assert (report.intervals, report.valid, report.segments, report.n_gaps, report.max_gap_h) == (600, 575, 3, 2, 20 / 6)
    stats = segments.gap_statistics(gappy, STEP).first()
    assert (stats.segments, stats.n_gaps, stats.gap_median, stats.gap_max) == (3, 2, 12.5, 20.0)
    assert segments.longest_block(segments.segment_ids(gappy, STEP)).count() == 280


def test_gap_distance(spark):
    df = frame(spark, [(k * STEP, 1.0) for k in (0, 1, 2, 5, 6, 9)])
    got = by_time(segments.gap_distance(df, STEP), "d", "gap_before", "to_gap")
    assert got == [(1, 0, 3), (2, 0, 2), (3, 0, 1), (1, 2, 2), (2, 2, 1), (1, 2, 10**9 - 9)]


def test_splits(whole):
    valid = origins.valid_origins(segments.segment_ids(whole, STEP), 60, 36, 1)
    split = origins.gap_aware_split(valid, 36, 1)
    n = valid.count()
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": int(0.75 * n), None: 37, "test": n - int(0.75 * n) - 37}
    naive = origins.calendar_split(features.with_target(whole, 1), origins.bounds_of(split))
    assert origins.uncovered(split, naive).isEmpty()
    last = naive.where("split = 'train'").agg(F.max("target_t")).first()[0]
    assert last < origins.bounds_of(split).first().test_start
    assert origins.gap_aware_split(valid.limit(500), 36, 1).isEmpty()
    folds = origins.fold_sizes(origins.walk_forward(whole)).orderBy("fold").collect()
    assert [(f.n_train, f.n_test) for f in folds] == [(250 * k, 250) for k in range(1, 6)]


def arms(df, x_aware="v", x_naive="v"):
    seg = segments.segment_ids(df, STEP)
    aware = origins.gap_aware_split(origins.valid_origins(seg, 10, 12, 1), 12, 1, least=100, least_test=30)
    naive = origins.calendar_split(features.with_target(df, 1), origins.bounds_of(aware))
    return scores.four_arms(aware, naive, x_aware, x_naive)


def test_decomposition_adds_up(spark, gappy, whole):
    r = arms(frame(spark, ar1(900, [(k, 4) for k in range(60, 880, 40)]))).first()
    assert r.feature + r.training + r.composition == pytest.approx(r.total) and r.feature == 0
    assert r.n_a == r.n_b == r.n_d < r.n_c and r.composition != 0
    assert arms(whole).first().composition == pytest.approx(0, abs=1e-9)
    shares = scores.channel_shares(arms(gappy), ["series_id"]).collect()
    assert all(s.share_feature + s.share_training + s.share_composition == pytest.approx(100) for s in shares)


def test_ridge_equals_closed_form(whole):
    names = ["lag_1", "lag_2", "roll_mean_5", "roll_std_5", "hour_sin"]
    rows = features.with_target(features.build_features(whole, 5, K), 1).dropna()
    got = models.fit_ridge(rows, names).first()
    data = np.array([[r[n] for n in [*names, "target"]] for r in rows.collect()])
    x, y = data[:, :-1], data[:, -1]
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(5), z.T @ (y - y.mean())) / x.std(0)
    assert got.weights == pytest.approx(w.tolist()) and got.intercept == pytest.approx(y.mean() - w @ x.mean(0))
    one = scores.fit_ridge1(rows, "lag_1").first()
    z = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()
    assert one._b == pytest.approx(z @ (y - y.mean()) / (z @ z + 1) / x[:, 0].std())


def slow_dm(e1, e2, h):
    d = e1**2 - e2**2
    n, c = len(d), d - d.mean()
    lag = min(n - 1, max(10, h - 1, math.floor(4 * (n / 100) ** (2 / 9))))
    s = c @ c / n + 2 * sum((1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
    return math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) * d.mean() / math.sqrt(max(1e-12, s / n))


def test_diebold_mariano(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 0.5, 2000), rng.normal(0, 1, 2000)
    df = spark.createDataFrame([("x", k, float(p), float(q)) for k, (p, q) in enumerate(zip(a, b, strict=True))], "series_id string, t bigint, a double, b double")
    r = hac.p_values(hac.diebold_mariano(df, F.col("a"), F.col("b"), 3), "dm").first()
    assert r.dm == pytest.approx(slow_dm(a, b, 3)) and r.dm < 0 and r.p < 1e-6
    same = hac.p_values(hac.diebold_mariano(df, F.col("a"), F.col("a"), 1), "dm").first()
    assert same.dm == 0 and same.p > 0.5
    cw = hac.p_values(hac.clark_west(df, F.col("a") * 2, F.lit(0.0), F.col("a"), 1), "cw").first()
    assert cw.cw > 0 and cw.p < 1e-6


def test_tails():
    assert special.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert special.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)


def test_rank_tests(spark):
    rng = random.Random(1)
    rows = [("x", k, float(rng.randrange(8)), rng.random() < 0.4) for k in range(60)]
    df = spark.createDataFrame(rows, "series_id string, t bigint, y double, g boolean")
    got = hac.mann_whitney(df, F.col("g"), "y").first()
    a, b = [y for *_, y, g in rows if g], [y for *_, y, g in rows if not g]
    assert got.u == sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    ties = sum(c**3 - c for c in Counter(y for *_, y, _ in rows).values())
    n = 60
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got.z == pytest.approx((got.u - len(a) * len(b) / 2 - 0.5) / sd)
    tests = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.012)], "name string, p double")
    assert {r.name for r in hac.holm(tests, "p", "name").where("supported").collect()} == {"a", "b", "c", "d"}
    assert {r.name for r in hac.holm(tests, "p", "name", 0.035).where("supported").collect()} == {"a"}


def test_bootstrap(spark, gappy):
    scored = segments.segment_ids(gappy, STEP).withColumn("e", F.col("v") - 8)
    rmse = scored.agg(F.sqrt(F.avg(F.col("e") * F.col("e")))).first()[0]
    ci = bootstrap.circular_rmse_interval(scored, F.col("e") * F.col("e"), 25, 200, 1).first()
    assert ci.ci_lo < rmse < ci.ci_hi and ci.n_reps == 200
    arm = scored.select("series_id", "t", (F.col("e") * 0.5).alias("em2"), F.abs("e").alias("ep2"))
    arm = arm.withColumn("em2", F.abs("em2"))
    blocks = bootstrap.segment_blocks(scored, 50)
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("seg").alias("s")).collect()
    assert max(b.n for b in sizes) <= 50 and all(b.s == 1 for b in sizes)
    same = bootstrap.bias_interval(arm, arm, blocks, 100, 1).first()
    assert (same.ci_lo, same.ci_hi) == (0, 0)
    w = bootstrap.cluster_weights(spark.range(10).withColumnRenamed("id", "cluster").withColumn("all", F.lit(1)), 20, 3, ["all"])
    assert {r["sum(weight)"] for r in w.groupBy("rep").sum("weight").collect()} == {10}


@pytest.mark.parametrize(("n", "drop", "nominal", "margin"), [(1500, 150, 6, 200), (1500, 151, 7, 200), (100, 47, 1, 2), (60, 40, 40, 5), (1000, 3, 50, 10)])
def test_planned_gaps_are_exact(spark, n, drop, nominal, margin):
    sizes = spark.createDataFrame([(f"s{k}", n) for k in range(8)], "series_id string, n bigint")
    plans = inject.plan_gaps(sizes, F.lit(drop), F.lit(nominal), 4, margin).collect()
    assert plans == inject.plan_gaps(sizes, F.lit(drop), F.lit(nominal), 4, margin).collect()
    by_series = {k: sorted((r.start, r.length) for r in plans if r.series_id == f"s{k}") for k in range(8)}
    assert len(set(map(tuple, by_series.values()))) > 1 or (n, drop) == (60, 40)
    for plan in by_series.values():
        assert sum(m for _, m in plan) == drop and len(plan) == max(1, round(drop / nominal)) and max(m for _, m in plan) - min(m for _, m in plan) <= 1
        assert all(a + m < b for (a, m), (b, _) in zip(plan, plan[1:], strict=False)) and plan[0][0] > margin and sum(plan[-1]) < n - margin


def test_gaps_without_room_are_not_planned(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 100), ("d", 0)], "series_id string, n bigint")
    got = inject.plan_gaps(sizes, F.floor(F.col("n") / 5), F.lit(4), 1, 10)
    assert {r.series_id: r["sum(length)"] for r in got.groupBy("series_id").sum("length").collect()} == {"a": 20, None: 20}
    assert inject.plan_gaps(sizes, F.lit(0), F.lit(4), 1, 10).isEmpty()


def test_injection(spark, whole):
    plan = inject.plan_gaps(spark.createDataFrame([("x", 1500)], "series_id string, n bigint"), F.lit(150), F.lit(6), 4).count()
    left = inject.inject_exact(whole, F.lit(150), F.lit(6), 4)
    assert left.count() == 1350 and segments.segment_ids(left, STEP).agg(F.max("seg")).first()[0] == plan == 25
    spread = inject.inject_stratified(whole, 0.1, 6, 1)
    lengths = segments.gap_statistics(spread, STEP).first()
    assert (lengths.n, lengths.n_gaps, lengths.gap_max) == (1350, 25, 6.0)


def test_far_from_gap_starts_equals_band_join(spark, gappy):
    d = segments.gap_distance(gappy, STEP)
    starts = d.where("to_gap = 1").select("series_id", (F.col("t") + STEP).alias("t"))
    got = {t for (t,) in by_time(profile.far_from_gap_starts(d, starts, 6, STEP), "t")}
    at = [t for (t,) in by_time(starts, "t")]
    assert got == {t for (t,) in by_time(d, "t") if all(abs(t - a) > 6 * STEP for a in at)}


def test_mixture_identity_is_exact(spark):
    r = scores.mixture_identity(spark.createDataFrame([(300, 200, 1.0, 1.7, 0.8, 1.5)], "n_valid int, n_displaced int, mp_valid double, mp_displaced double, mm_valid double, mm_displaced double")).first()
    all_m, all_p = (300 * 0.8 + 200 * 1.5) / 500, (300 * 1.0 + 200 * 1.7) / 500
    want = 100 * (1 - math.sqrt(all_m / all_p)) - 100 * (1 - math.sqrt(0.8))
    assert r.exact == pytest.approx(want) and r.f == 0.4


def test_result_tables(spark):
    rows = [("r", c, s, k, b + k) for c, b in (("MANY-SHORT", 9.0), ("MEDIUM", 5.0), ("FEW-LONG", 1.0)) for s in (5, 10) for k in range(3) if not (c == "MEDIUM" and s == 10 and k == 2)]
    df = spark.createDataFrame(rows, "record string, condition string, share int, k int, bias double")
    cells = summary.cell_means(df, "bias", ["record", "share"])
    assert {(r.share, r.MEDIUM) for r in cells.collect()} == {(5, 6.0), (10, None)}
    assert [tuple(r) for r in summary.monotonic(cells, ["record"]).collect()] == [("r", 1, 1)]
    edges = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 9.0)], "x double").select(summary.right_closed_bins(F.col("x"), [0, 1, 2]).alias("b"))
    assert [r.b for r in edges.collect()] == [None, 0, 1, 1, None]
    best = summary.best_of(df, "bias", ["share"], ["record"]).first()
    assert (best.condition, best.share) == ("FEW-LONG", 5)


def arma_plain(history, window=301):
    """The same forecast for one row, by numpy: an AR(3) by Yule-Walker, matched to an ARMA(2, 1), errors of the last rows by recursion."""
    x = np.asarray(history[-window:], float)
    n, mu = len(x), np.mean(x)
    z = x - mu
    if n < 30 or z @ z / n <= 1e-12:
        return None
    c = [z[k:] @ z[: n - k] / n for k in range(4)]
    a1, a2, a3 = np.linalg.solve(np.array([[c[abs(i - j)] for j in range(3)] for i in range(3)]), c[1:])
    theta = float(np.clip(-a3 / a2 if a2 else 0.0, -models.THETA, models.THETA))
    p1, p2 = a1 - theta, a2 + theta * a1
    whole = np.asarray(history, float) - mu
    e = 0.0
    for k in range(max(2, len(whole) - 1 - models.ERRORS), len(whole)):
        e = whole[k] - p1 * whole[k - 1] - p2 * whole[k - 2] - theta * e
    return mu + p1 * whole[-1] + p2 * whole[-2] + theta * e


def test_arma_forecasts(spark):
    rng = np.random.default_rng(0)
    x = [5.0]
    for _ in range(899):
        x.append(5 + 0.8 * (x[-1] - 5) + rng.normal(0, 0.1))
    rows = [("a", 0 if k < 500 else 1, k + 10 * (k >= 500), v) for k, v in enumerate(x)] + [("b", 0, k, 2.0) for k in range(60)]
    made = models.arma_predictions(spark.createDataFrame(rows, "series_id string, seg int, t bigint, v double"), 1)
    got = {(r.series_id, r.t): r.prediction for r in made.collect()}
    for k in (0, 28, 29, 30, 200, 300, 301, 330, 331, 332, 499, 500, 529, 530, 899):
        own = x[: k + 1] if k < 500 else x[500 : k + 1]
        want, found = arma_plain(own), got["a", k + 10 * (k >= 500)]
        assert (want is None and found is None) or found == pytest.approx(want, abs=1e-6)
    assert all(v is None for (s, _), v in got.items() if s == "b")
    errors = [got["a", k] - x[k + 1] for k in range(250, 480)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.12
