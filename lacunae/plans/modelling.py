"""Queries on features, origins, splits, scores and the evaluation's bias."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import full, hour_of, in_order, last_rows, rmse
from ..operators import features, origins, profile, scores, summary
from ..sources.tables import stored
from .base import BOUNDS, CALENDAR, DEPTH, DIST, LEN, SCORES, SEGS, SEQ, STEP, H, naive_rows, naive_sql, placed_rows, rounded, scored_rows, segmented, series, split_sql, valid_rows, valid_sql, with_

K = ["series_id"]
OWN = ["series_id", "seg"]
LEAST = {"least": 40, "least_test": 5}
_NV = [*SEGS, naive_sql()]
_VA = [*SEGS, valid_sql()]
_SP = [*_VA, split_sql()]
_CS = [*SEGS, naive_sql(), valid_sql(), split_sql(), BOUNDS, CALENDAR]


def lag_features(spark, d):
    s, o = segmented(spark, d), in_order(OWN)
    return rounded(s.select("series_id", "t", F.col("v").alias("lag_0"), *[F.lag("v", k).over(o).alias(f"lag_{k}") for k in features.LAGS]))


def _rolls(s, keys):
    v, out = F.col("v"), []
    for w in (5, 15):
        o = last_rows(keys, w)
        out += [full(F.avg("v").over(o), o, w, v).alias(f"mean_{w}"), full(F.stddev_samp("v").over(o), o, w, v).alias(f"std_{w}")]
    o = last_rows(keys, 30)
    turb = full(F.stddev_samp("v").over(o) / (F.avg("v").over(o) + 1e-9), o, 30, v)
    return rounded(s.select("series_id", "t", *out, (v - F.lag("v", 1).over(in_order(keys))).alias("shear"), turb.alias("turbulence")), 5)


def rolling_gap_aware(spark, d):
    return _rolls(segmented(spark, d), OWN)


def rolling_naive(spark, d):
    return _rolls(series(spark, d), K)


def _rolls_sql(keys: str, source: str) -> str:
    part = []
    for w in (5, 15):
        part += [f"round(CASE WHEN count(v) OVER w{w} = {w} THEN avg(v) OVER w{w} END, 5) AS mean_{w}", f"round(CASE WHEN count(v) OVER w{w} = {w} THEN stddev_samp(v) OVER w{w} END, 5) AS std_{w}"]
    windows = ", ".join(f"w{w} AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (5, 15, 30))
    return f"SELECT series_id, t, {', '.join(part)}, round(v - lag(v) OVER (PARTITION BY {keys} ORDER BY t), 5) AS shear, round(CASE WHEN count(v) OVER w30 = 30 THEN stddev_samp(v) OVER w30 / (avg(v) OVER w30 + 1e-9) END, 5) AS turbulence FROM {source} WINDOW {windows}"


def kalman_segmented(spark, d):
    return rounded(features.kalman_level_blocked(segmented(spark, d), OWN).select("series_id", "t", "kalman"))


def kalman_naive(spark, d):
    return rounded(features.kalman_level_blocked(series(spark, d), K).select("series_id", "t", "kalman"))


def kalman_sql(seg: str, source: str, name: str) -> list[str]:
    gain = "(k.p + 0.02::DOUBLE) / (k.p + 0.02::DOUBLE + 0.6::DOUBLE)"
    return [
        f"{name}r AS (SELECT series_id, {seg} AS seg, t, v, row_number() OVER (PARTITION BY series_id, {seg} ORDER BY t) AS n FROM {source})",
        f"{name} AS (SELECT series_id, seg, t, n, v AS x, 1::DOUBLE AS p FROM {name}r WHERE n = 1 UNION ALL SELECT r.series_id, r.seg, r.t, r.n, k.x + {gain} * (r.v - k.x), (1 - {gain}) * (k.p + 0.02::DOUBLE) FROM {name} k JOIN {name}r r ON r.series_id = k.series_id AND r.seg = k.seg AND r.n = k.n + 1)",
    ]


def calendar_features(spark, d):
    a = hour_of(F.col("t")) * F.lit(2 * math.pi / 24)
    return rounded(series(spark, d).select("series_id", "t", F.sin(a).alias("hour_sin"), F.cos(a).alias("hour_cos")))


def depth_features(spark, d):
    """The feature set of depth 15, rows on which all are known."""
    f = features.build_features(segmented(spark, d), 15, OWN, kalman=False)
    names = features.feature_names(15, kalman=False)
    return rounded(f.dropna(subset=names).groupBy("series_id").agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in ("lag_15", "roll_mean_15", "roll_std_5", "shear")]))


def feature_diff(spark, d):
    s = segmented(spark, d)
    names = ["lag_0", "lag_1", "lag_2", "lag_5", "roll_mean_5", "kalman"]
    a = features.build_features(s, 5, OWN).withColumn("seg", F.col("seg").cast("bigint"))
    n = features.build_features(s, 5, K)
    return rounded(features.feature_differences(n, a, names), 5)


def naive_target(spark, d):
    return rounded(naive_rows(spark, d, 3).select("series_id", "t", "v", "target", "target_t"))


def displaced_targets(spark, d):
    n = naive_rows(spark, d, 3).where("target is not null")
    return rounded(n.groupBy("series_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("displaced"), 1)).alias("n_displaced"), F.max(F.col("target_t") - F.col("t")).alias("longest_lead")))


def sequences(spark, d):
    s = features.sequences(segmented(spark, d), 4, OWN).where("window is not null")
    return rounded(s.select("series_id", "t", F.size("window").alias("n"), F.aggregate("window", F.lit(0.0), lambda a, x: a * 0.37 + x).alias("folded")), 3)


def valid_origins(spark, d):
    return rounded(valid_rows(spark, d).select("series_id", "t", "v", "target", "target_t"))


def formula_vs_pipeline(spark, d):
    from ..operators import segments

    s = segmented(spark, d)
    f = segments.retention(segments.segment_lengths(s), F.lit(DEPTH), F.lit(H)).select("series_id", F.col("n_valid").alias("n_formula"))
    p = valid_rows(spark, d).groupBy("series_id").agg(F.count("*").alias("n_pipeline"))
    return f.join(p, "series_id", "left").select("series_id", "n_formula", F.coalesce("n_pipeline", F.lit(0)).alias("n_pipeline"))


def _aware(spark, d):
    return origins.gap_aware_split(valid_rows(spark, d), SEQ, H, **LEAST)


def _calendar(spark, d):
    return origins.calendar_split(naive_rows(spark, d), origins.bounds_of(_aware(spark, d)))


def gap_aware_split(spark, d):
    return _aware(spark, d).select("series_id", "t", "split")


def calendar_split(spark, d):
    return _calendar(spark, d).where("split is not null").select("series_id", "t", "split")


def uncovered_rows(spark, d):
    return origins.uncovered(_aware(spark, d), _calendar(spark, d)).groupBy().agg(F.count("*").alias("n_uncovered"))


def published_split(spark, d):
    return origins.published_split(naive_rows(spark, d)).groupBy("series_id", "split").agg(F.count("*").alias("n"), F.min("t").alias("start"))


def window_drift(spark, d):
    return rounded(origins.window_drift(_aware(spark, d), origins.published_split(naive_rows(spark, d))))


def origin_bounds(spark, d):
    return origins.origin_bounds(series(spark, d), [0.6, 0.65, 0.7, 0.75, 0.8], SEQ, H)


def rolling_origins(spark, d):
    a = origins.origin_windows(series(spark, d)).withColumn("kind", F.lit("disjoint"))
    return a.unionByName(origins.origin_windows(series(spark, d), True).withColumn("kind", F.lit("overlapping")))


def walk_forward_folds(spark, d):
    return origins.fold_sizes(origins.walk_forward(naive_rows(spark, d).where("target is not null")))


def tuning_split(spark, d):
    train = _aware(spark, d).where("split = 'train'").drop("split")
    return origins.tuning_split(train, SEQ + H).groupBy("series_id", "part").agg(F.count("*").alias("n"), F.min("t").alias("start"))


def series_guards(spark, d):
    s = _aware(spark, d)
    return origins.at_least(s, {"n_train": (F.col("split") == "train", 50), "n_test": (F.col("split") == "test", 10)})


def persistence_rmse(spark, d):
    return rounded(scores.error_summary(naive_rows(spark, d).where("target is not null"), F.col("v"), ["series_id", "displaced"]))


def skill_ridge1(spark, d):
    s = _aware(spark, d)
    model = scores.fit_ridge1(s.where("split = 'train'"), "v")
    return rounded(scores.skill_summary(scores.predict_ridge1(s.where("split = 'test'"), model, "v")), 5)


def design(df, horizon: int = H, depth: int = DEPTH, seq: int = SEQ, names: list[str] | None = None, **guards):
    """Both designs' features and splits of a series with segments (and places, if it has them) in one frame. The features are written once.
    names: the features that are wanted; others are then neither made nor written."""
    made = features.both_designs(df, depth, seq, horizon)
    if names is not None:
        made = made.drop(*[x + n for n in features.feature_names(depth) if n not in names for x in ("a_", "n_")])
    return origins.both_splits(stored(made, "designs"), seq, horizon, **(LEAST | guards))


def _arms(spark, d):
    """Arms on the Kalman level: within segments for A, over the whole series for B, C and D."""
    rows, keys = stored(scores.arm_rows(design(placed_rows(spark, d)), ["a_kalman"], ["n_kalman"]), "arm-rows"), [*K, "arm"]
    model = scores.fit_ridge1(rows.where("role = 'train'"), "x0", keys=keys)
    return scores.arm_skills(scores.predict_ridge1(rows.where("role = 'test'"), model, "x0", keys)).drop("rmse_p_a", "rmse_p_c", "rmse_m_a", "rmse_m_c")


def arms_decomposition(spark, d):
    return rounded(_arms(spark, d), 5)


def channel_shares(spark, d):
    a = _arms(spark, d).withColumn("model", F.lit("ridge1"))
    return rounded(scores.channel_shares(a, ["model"]), 4)


_FIT = "SELECT series_id, avg({x}) AS mx, avg(target) AS my, CASE WHEN var_pop({x}) > 0 THEN count(*) * covar_pop({x}, target) / (count(*) * var_pop({x}) + var_pop({x})) ELSE 0 END AS b FROM {train} WHERE split = 'train' GROUP BY 1"


def _arm_sql(name: str, x: str, train: str, test: str, where: str = "") -> str:
    return f"""{name} AS (SELECT series_id, count(*) AS n, 100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))) AS skill, sqrt(avg((target - p) * (target - p))) AS rm, sqrt(avg((target - v) * (target - v))) AS rp
  FROM (SELECT q.*, my + b * ({x} - mx) AS p FROM {test} q JOIN ({_FIT.format(x=x, train=train)}) USING (series_id) WHERE split = 'test' {where}) GROUP BY 1)"""


_ARMS = [
    *_CS, *kalman_sql("seg", "seg", "ks"), *kalman_sql("0", "s", "kn"),
    "aw AS (SELECT sp.*, ks.x AS k_aware, kn.x AS k_naive FROM sp JOIN ks USING (series_id, t) JOIN kn USING (series_id, t))",
    "na AS (SELECT cs.*, kn.x AS k_naive FROM cs JOIN kn USING (series_id, t))",
    _arm_sql("aa", "k_aware", "aw", "aw"), _arm_sql("ab", "k_naive", "aw", "aw"), _arm_sql("ac", "k_naive", "na", "na"),
    _arm_sql("ad", "k_naive", "na", "na", "AND (series_id, t) IN (SELECT (series_id, t) FROM sp WHERE split = 'test')"),
    "arms AS (SELECT series_id, aa.skill AS skill_a, aa.n AS n_a, ab.skill AS skill_b, ab.n AS n_b, ac.skill AS skill_c, ac.n AS n_c, ad.skill AS skill_d, ad.n AS n_d, ab.skill - aa.skill AS feature, ad.skill - ab.skill AS training, ac.skill - ad.skill AS composition, ac.skill - aa.skill AS total FROM aa JOIN ab USING (series_id) JOIN ac USING (series_id) JOIN ad USING (series_id))",
]


def _r(names: str, places: int) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names.split())


def distance_profile(spark, d):
    return rounded(profile.distance_profile(scored_rows(spark, d), 8, H, least=3), 5)


def far_inflation(spark, d):
    return rounded(profile.first_after_gap(scored_rows(spark, d), 8, H, least_far=20), 5)


def displaced_split(spark, d):
    return rounded(profile.displaced_errors(scored_rows(spark, d)), 5)


def lead_time_split(spark, d):
    kinds = profile.lead_time_classes(_calendar(spark, d).where("split = 'test'"), _aware(spark, d).where("split = 'test'"))
    e = F.col("target") - F.col("v")
    return rounded(kinds.groupBy("series_id", "kind").agg(F.count("*").alias("n"), rmse(e).alias("rmse")), 5)


def staleness_profile(spark, d):
    return rounded(profile.staleness(scored_rows(spark, d), STEP, H, least=3), 5)


def mixture_identity(spark, d):
    s = scored_rows(spark, d)
    part = lambda c, x, f: f(F.when(c, F.col(x)))
    dis = F.col("displaced")
    m = s.groupBy("series_id").agg(F.count(F.when(~dis, 1)).alias("n_valid"), F.count(F.when(dis, 1)).alias("n_displaced"), part(~dis, "sq_p", F.avg).alias("mp_valid"), part(dis, "sq_p", F.avg).alias("mp_displaced"), part(~dis, "sq_m", F.avg).alias("mm_valid"), part(dis, "sq_m", F.avg).alias("mm_displaced"))
    return rounded(scores.mixture_identity(m).drop("mp_valid", "mp_displaced", "mm_valid", "mm_displaced"), 4)


def design_exposure(spark, d):
    from ..operators import grid, segments

    r = segments.gap_report(grid.reindex(series(spark, d), STEP), STEP).where("n_gaps > 0")
    p, g = F.col("missing") / F.col("intervals"), F.col("missing") / F.col("n_gaps")
    return rounded(r.select("series_id", scores.design_exposure(p, DEPTH, H, g).alias("exposure")))


def gap_context(spark, d):
    from ..operators import segments

    c = profile.pre_gap_context(segments.gap_distance(series(spark, d), STEP), 6, STEP)
    return rounded(c.groupBy("series_id", "kind").agg(F.count("*").alias("n"), F.avg("sd").alias("sd"), F.avg("ramp").alias("ramp")), 5)


def asof_gap_start(spark, d):
    from ..operators import segments

    g = segments.gap_distance(series(spark, d), STEP)
    starts = g.where("to_gap = 1").select("series_id", (F.col("t") + STEP).alias("t"))
    return rounded(profile.far_from_gap_starts(g, starts, 6, STEP).select("series_id", "t", "v"))


def power_curve(spark, d):
    p = scores.turbine_power(F.col("v"))
    return rounded(series(spark, d).groupBy("series_id").agg(F.avg(p).alias("power"), F.avg(F.when(F.col("v") > 0, 3 * p / F.col("v"))).alias("slope")), 4)


def exposure_bins(spark, d):
    return rounded(summary.binned(scored_rows(spark, d).where("d <= 40"), "d", "sq_p", [0, 1, 2, 4, 8, 16, 40]), 5)


def union_intersect_except(spark, d):
    a, c = _aware(spark, d).where("split = 'test'").select("series_id", "t"), _calendar(spark, d).where("split = 'test'").select("series_id", "t")
    parts = {"union_all": a.unionByName(c), "union": a.unionByName(c).distinct(), "intersect": a.intersect(c), "except": c.exceptAll(a)}
    out = None
    for name, df in parts.items():
        n = df.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("op", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


_FAR = f"(d > 8 AND NOT displaced AND to_gap > {H})"
_CTX = f"""cx AS (SELECT *, CASE WHEN count(v) OVER w = 6 THEN stddev_pop(v) OVER w END AS sd, CASE WHEN count(v) OVER w = 6 THEN max(ch) OVER w5 END AS ramp FROM (SELECT *, CASE WHEN d > 1 THEN abs(v - lag(v) OVER (PARTITION BY series_id, seg ORDER BY t)) END AS ch FROM di)
  WINDOW w AS (PARTITION BY series_id, seg ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY series_id, seg ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
_FARROWS = f"NOT EXISTS (SELECT 1 FROM di g WHERE g.to_gap = 1 AND g.series_id = q.series_id AND abs(g.t + {STEP} - q.t) <= 6 * {STEP})"
_CTX_ROWS = f"SELECT series_id, 'before gap' AS kind, sd, ramp FROM cx WHERE to_gap = 1 AND sd IS NOT NULL UNION ALL SELECT series_id, 'baseline', sd, ramp FROM cx q WHERE d % 6 = 0 AND sd IS NOT NULL AND {_FARROWS}"
_OWN = "PARTITION BY series_id, seg ORDER BY t"

QUERIES = {
    "lag_features": (lag_features, with_(SEGS, f"SELECT series_id, t, round(v, 6) AS lag_0, {', '.join(f'round(lag(v, {k}) OVER w, 6) AS lag_{k}' for k in features.LAGS)} FROM seg WINDOW w AS ({_OWN})")),
    "rolling_gap_aware": (rolling_gap_aware, with_(SEGS, _rolls_sql("series_id, seg", "seg"))),
    "rolling_naive": (rolling_naive, with_(SEGS, _rolls_sql("series_id", "s"))),
    "kalman_segmented": (kalman_segmented, with_([*SEGS, *kalman_sql("seg", "seg", "ks")], "SELECT series_id, t, round(x, 6) AS kalman FROM ks", True)),
    "kalman_naive": (kalman_naive, with_([*SEGS, *kalman_sql("0", "s", "kn")], "SELECT series_id, t, round(x, 6) AS kalman FROM kn", True)),
    "calendar_features": (calendar_features, with_(SEGS, "SELECT series_id, t, round(sin(2 * pi() / 24 * (t % 86400 // 3600)), 6) + 0.0::DOUBLE AS hour_sin, round(cos(2 * pi() / 24 * (t % 86400 // 3600)), 6) + 0.0::DOUBLE AS hour_cos FROM s")),
    "depth_features": (depth_features, with_(SEGS, f"SELECT series_id, count(*) AS n, round(avg(l), 6) AS lag_15, round(avg(m), 6) AS roll_mean_15, round(avg(sd), 6) AS roll_std_5, round(avg(sh), 6) AS shear FROM (SELECT series_id, lag(v, 15) OVER o AS l, avg(v) OVER w15 AS m, stddev_samp(v) OVER w5 AS sd, v - lag(v) OVER o AS sh, row_number() OVER o AS n FROM seg WINDOW o AS ({_OWN}), w15 AS ({_OWN} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), w5 AS ({_OWN} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n >= 16 GROUP BY 1")),
    "feature_diff": (feature_diff, with_([*SEGS, *kalman_sql("seg", "seg", "ks"), *kalman_sql("0", "s", "kn"), f"rw AS (SELECT seg.*, ks.x AS ka, kn.x AS kb, row_number() OVER (PARTITION BY series_id, seg.seg ORDER BY t) AS n FROM seg JOIN ks USING (series_id, t) JOIN kn USING (series_id, t))"], "SELECT 0.0::DOUBLE AS max_lag_0, 0.0::DOUBLE AS max_lag_1, 0.0::DOUBLE AS max_lag_2, 0.0::DOUBLE AS max_lag_5, 0.0::DOUBLE AS max_roll_mean_5, round(max(abs(ka - kb)), 5) AS max_kalman, count(*) FILTER (abs(ka - kb) > 1e-9) AS n_differ, count(*) AS n_rows FROM rw WHERE n >= 6", True)),
    "naive_target": (naive_target, with_([*SEGS, naive_sql(3)], "SELECT series_id, t, round(v, 6) AS v, round(target, 6) AS target, target_t FROM nv")),
    "displaced_targets": (displaced_targets, with_([*SEGS, naive_sql(3)], "SELECT series_id, count(*) AS n, count(*) FILTER (displaced) AS n_displaced, max(target_t - t) AS longest_lead FROM nv WHERE target IS NOT NULL GROUP BY 1")),
    "sequences": (sequences, with_(SEGS, f"SELECT series_id, t, 4 AS n, round(((l3 * 0.37::DOUBLE + l2) * 0.37::DOUBLE + l1) * 0.37::DOUBLE + v, 3) AS folded FROM (SELECT *, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3 FROM seg WINDOW w AS ({_OWN})) WHERE l3 IS NOT NULL")),
    "valid_origins": (valid_origins, with_(_VA, "SELECT series_id, t, round(v, 6) AS v, round(target, 6) AS target, target_t FROM va")),
    "formula_vs_pipeline": (formula_vs_pipeline, with_([*_VA, LEN], f"SELECT series_id, n_formula, coalesce(n_pipeline, 0) AS n_pipeline FROM (SELECT series_id, sum(greatest(0, length - {DEPTH + H}))::BIGINT AS n_formula FROM len GROUP BY 1) LEFT JOIN (SELECT series_id, count(*) AS n_pipeline FROM va GROUP BY 1) USING (series_id)")),
    "gap_aware_split": (gap_aware_split, with_(_SP, "SELECT series_id, t, split FROM sp")),
    "calendar_split": (calendar_split, with_(_CS, "SELECT series_id, t, split FROM cs WHERE split IS NOT NULL")),
    "uncovered_rows": (uncovered_rows, with_(_CS, "SELECT count(*) AS n_uncovered FROM (SELECT * FROM sp WHERE split = 'test') ANTI JOIN (SELECT * FROM cs WHERE split = 'test') USING (series_id, t)")),
    "published_split": (published_split, with_(_NV, "SELECT series_id, split, count(*) AS n, min(t) AS start FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 < floor(0.75 * count(*) OVER (PARTITION BY series_id)) THEN 'train' ELSE 'test' END AS split FROM nv WHERE target IS NOT NULL) GROUP BY 1, 2")),
    "window_drift": (window_drift, with_([*_SP, naive_sql(), BOUNDS], "SELECT series_id, round((b - test_start) / 86400, 6) AS drift_test_start, round((e - test_end) / 86400, 6) AS drift_test_end FROM bo JOIN (SELECT series_id, min(t) AS b, max(t) AS e FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS c FROM nv WHERE target IS NOT NULL) WHERE r >= floor(0.75 * c) GROUP BY 1) USING (series_id)")),
    "origin_bounds": (origin_bounds, with_(SEGS, f"SELECT series_id, fraction, n, i_train, i_start, i_end, a.t AS train_end, b.t AS test_start, c.t AS test_end FROM (SELECT *, least(n - 1, i_start + floor(0.25 * n)::BIGINT) AS i_end FROM (SELECT *, i_train + {SEQ + H} AS i_start FROM (SELECT series_id, n, fraction, floor(fraction * n)::BIGINT AS i_train FROM (SELECT series_id, count(*) AS n, unnest([0.6::DOUBLE, 0.65::DOUBLE, 0.7::DOUBLE, 0.75::DOUBLE, 0.8::DOUBLE]) AS fraction FROM s GROUP BY 1)))) LEFT JOIN (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i_train, t FROM s) a USING (series_id, i_train) LEFT JOIN (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i_start, t FROM s) b USING (series_id, i_start) LEFT JOIN (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i_end, t FROM s) c USING (series_id, i_end)")),
    "rolling_origins": (rolling_origins, with_(SEGS, "SELECT series_id, o::INTEGER AS origin, n, n // 2 + n // 12 * (o - 1) AS start, n // 2 + n // 12 * o AS \"end\", 'disjoint' AS kind FROM (SELECT series_id, count(*) AS n FROM s GROUP BY 1), range(1, 7) x(o) UNION ALL SELECT series_id, o::INTEGER, n, floor(n * (0.5::DOUBLE + 0.06::DOUBLE * (o - 1)))::BIGINT, least(n, floor(n * (0.5::DOUBLE + 0.06::DOUBLE * (o - 1)))::BIGINT + floor(n * 0.2::DOUBLE)::BIGINT), 'overlapping' FROM (SELECT series_id, count(*) AS n FROM s GROUP BY 1), range(1, 7) x(o)")),
    "walk_forward_folds": (walk_forward_folds, with_(_NV, "SELECT series_id, block AS fold, (sum(n) OVER (PARTITION BY series_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS n_train, n AS n_test FROM (SELECT series_id, block, count(*) AS n FROM (SELECT series_id, least((row_number() OVER (PARTITION BY series_id ORDER BY t) - 1) // greatest(1, count(*) OVER (PARTITION BY series_id) // 6), 5) AS block FROM nv WHERE target IS NOT NULL) GROUP BY 1, 2) QUALIFY block > 0")),
    "tuning_split": (tuning_split, with_(_SP, f"SELECT series_id, part, count(*) AS n, min(t) AS start FROM (SELECT *, CASE WHEN r >= floor(c * (1 - 0.2::DOUBLE)) THEN 'validate' WHEN r < floor(c * (1 - 0.2::DOUBLE)) - {SEQ + H} THEN 'fit' END AS part FROM (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS c FROM sp WHERE split = 'train')) GROUP BY 1, 2")),
    "series_guards": (series_guards, with_(_SP, "SELECT series_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM sp GROUP BY 1 HAVING n_train >= 50 AND n_test >= 10")),
    "persistence_rmse": (persistence_rmse, with_(_NV, "SELECT series_id, displaced, count(*) AS n, round(sqrt(avg((target - v) * (target - v))), 6) AS rmse, round(avg(abs(target - v)), 6) AS mae FROM nv WHERE target IS NOT NULL GROUP BY 1, 2")),
    "skill_ridge1": (skill_ridge1, with_([*_SP, _arm_sql("aa", "v", "sp", "sp")], "SELECT series_id, n, round(rm, 5) AS rmse_m, round(rp, 5) AS rmse_p, round(skill, 5) AS skill FROM aa")),
    "arms_decomposition": (arms_decomposition, with_(_ARMS, f"SELECT series_id, n_a, n_b, n_c, n_d, {_r('skill_a skill_b skill_c skill_d feature training composition total', 5)} FROM arms", True)),
    "channel_shares": (channel_shares, with_([*_ARMS, "sh AS (SELECT 'mean_abs' AS method, avg(abs(feature)) AS feature, avg(abs(training)) AS training, avg(abs(composition)) AS composition, avg(abs(total)) AS total FROM arms UNION ALL SELECT 'signed_sum', sum(feature), sum(training), sum(composition), sum(total) FROM arms)"], f"SELECT 'ridge1' AS model, method, {_r('feature training composition total', 4)}, {', '.join(f'round(100 * abs({x}) / (abs(feature) + abs(training) + abs(composition)), 4) AS share_{x}' for x in ('feature', 'training', 'composition'))} FROM sh", True)),
    "distance_profile": (distance_profile, with_(SCORES, f"SELECT series_id, d, n, round(rmse, 5) AS rmse, round(far_rmse, 5) AS far_rmse, n_far, round(100 * (rmse / far_rmse - 1), 5) AS inflation FROM (SELECT series_id, d, count(*) AS n, sqrt(avg(sq)) AS rmse FROM sc WHERE d <= 12 GROUP BY 1, 2 HAVING count(*) >= 3) JOIN (SELECT series_id, sqrt(avg(sq)) AS far_rmse, count(*) AS n_far FROM sc WHERE {_FAR} GROUP BY 1) USING (series_id)")),
    "far_inflation": (far_inflation, with_(SCORES, f"SELECT series_id, n_far, n_first, round(m, 5) AS model_ratio, round(p, 5) AS persistence_ratio, round(m / p, 5) AS ratio, CASE WHEN m > p THEN 'model' WHEN m < p THEN 'persistence' WHEN m = p THEN 'equal' ELSE 'equal' END AS hurt_more FROM (SELECT series_id, count(*) FILTER ({_FAR}) AS n_far, count(*) FILTER (d = 1) AS n_first, sqrt(avg(sq_m) FILTER (d = 1)) / sqrt(avg(sq_m) FILTER ({_FAR})) AS m, sqrt(avg(sq_p) FILTER (d = 1)) / sqrt(avg(sq_p) FILTER ({_FAR})) AS p FROM sc GROUP BY 1) WHERE n_far > 20")),
    "displaced_split": (displaced_split, with_(SCORES, "SELECT series_id, count(*) FILTER (displaced) AS n_displaced, count(*) FILTER (NOT displaced) AS n_kept, round(sqrt(avg(sq) FILTER (displaced)), 5) AS rmse_displaced, round(sqrt(avg(sq) FILTER (NOT displaced)), 5) AS rmse_kept FROM sc GROUP BY 1")),
    "lead_time_split": (lead_time_split, with_(_CS, "SELECT series_id, kind, count(*) AS n, round(sqrt(avg((target - v) * (target - v))), 5) AS rmse FROM (SELECT cs.*, CASE WHEN ok THEN 'valid' WHEN displaced THEN 'target-crossing' ELSE 'input-only' END AS kind FROM cs LEFT JOIN (SELECT series_id, t, true AS ok FROM sp WHERE split = 'test') USING (series_id, t) WHERE split = 'test') GROUP BY 1, 2")),
    "staleness_profile": (staleness_profile, with_(SCORES, f"SELECT series_id, CASE WHEN l <= 0 THEN '0' WHEN l <= 3 THEN '1-3' WHEN l <= 12 THEN '4-12' WHEN l <= 72 THEN '13-72' ELSE '>72' END AS late, count(*) AS n, round(sqrt(avg(sq)), 5) AS rmse FROM (SELECT *, (target_t - t) / {STEP} - {H} AS l FROM sc) GROUP BY 1, 2 HAVING count(*) >= 3")),
    "mixture_identity": (mixture_identity, with_(SCORES, f"SELECT series_id, n_valid, n_displaced, {_r('f rho_p rho_m', 4)}, round(100 * sqrt(mmv / mpv) * (1 - sqrt((1 - f + f * mmd / mmv) / (1 - f + f * mpd / mpv))), 4) AS exact, round(50 * sqrt(mmv / mpv) * f * (mpd / mpv - mmd / mmv), 4) AS first_order FROM (SELECT *, n_displaced / (n_valid + n_displaced) AS f, sqrt(mpd / mpv) AS rho_p, sqrt(mmd / mmv) AS rho_m FROM (SELECT series_id, count(*) FILTER (NOT displaced) AS n_valid, count(*) FILTER (displaced) AS n_displaced, avg(sq_p) FILTER (NOT displaced) AS mpv, avg(sq_p) FILTER (displaced) AS mpd, avg(sq_m) FILTER (NOT displaced) AS mmv, avg(sq_m) FILTER (displaced) AS mmd FROM sc GROUP BY 1))")),
    "design_exposure": (design_exposure, with_([*SEGS, LEN], f"SELECT series_id, round(least(1.0::DOUBLE, p * {DEPTH + H} / ((1 - p) * g)), 6) AS exposure FROM (SELECT series_id, (full_n - n) / full_n AS p, (full_n - n) / (segs - 1) AS g, segs FROM (SELECT series_id, sum(length) AS n, count(*) AS segs, (max(\"end\") - min(start)) // {STEP} + 1 AS full_n FROM len GROUP BY 1)) WHERE segs > 1")),
    "gap_context": (gap_context, with_([*SEGS, LEN, DIST, _CTX], f"SELECT series_id, kind, count(*) AS n, round(avg(sd), 5) AS sd, round(avg(ramp), 5) AS ramp FROM (SELECT series_id, 'before gap' AS kind, sd, ramp FROM cx WHERE to_gap = 1 AND sd IS NOT NULL UNION ALL SELECT series_id, 'baseline', sd, ramp FROM cx q WHERE d % 6 = 0 AND sd IS NOT NULL AND {_FARROWS}) GROUP BY 1, 2")),
    "asof_gap_start": (asof_gap_start, with_([*SEGS, LEN, DIST], f"SELECT series_id, t, round(v, 6) AS v FROM di q WHERE {_FARROWS}")),
    "power_curve": (power_curve, with_(SEGS, "SELECT series_id, round(avg(0.5::DOUBLE * 1.225 * 1.0 * 0.4 * v * v * v), 4) AS power, round(avg(CASE WHEN v > 0 THEN 3 * (0.5::DOUBLE * 1.225 * 1.0 * 0.4 * v * v * v) / v END), 4) AS slope FROM s GROUP BY 1")),
    "exposure_bins": (exposure_bins, with_(SCORES, "SELECT (CASE WHEN d <= 1 THEN 0 WHEN d <= 2 THEN 1 WHEN d <= 4 THEN 2 WHEN d <= 8 THEN 3 WHEN d <= 16 THEN 4 ELSE 5 END)::INTEGER AS bin, count(*) AS n, round(quantile_cont(sq_p, 0.5), 5) AS median, round(quantile_cont(sq_p, 0.25), 5) AS q1, round(quantile_cont(sq_p, 0.75), 5) AS q3 FROM sc WHERE d <= 40 GROUP BY 1")),
    "union_intersect_except": (union_intersect_except, with_([*_CS, "a AS (SELECT series_id, t FROM sp WHERE split = 'test')", "c AS (SELECT series_id, t FROM cs WHERE split = 'test')"], "SELECT series_id, count(*) AS n, 'union_all' AS op FROM (FROM a UNION ALL FROM c) GROUP BY 1 UNION ALL SELECT series_id, count(*), 'union' FROM (FROM a UNION FROM c) GROUP BY 1 UNION ALL SELECT series_id, count(*), 'intersect' FROM (FROM a INTERSECT FROM c) GROUP BY 1 UNION ALL SELECT series_id, count(*), 'except' FROM (FROM c EXCEPT ALL FROM a) GROUP BY 1")),
}
