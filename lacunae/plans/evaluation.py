"""The evaluation as a whole: the aligned main table, arms on every model, walk-forward gap profiles, origins with refits, injection sweeps.

Every table comes from one frame of rows with both designs' features and splits; models are fitted for each record (and arm, fold,
origin, horizon, seed) by one aggregate or one grouped function. Ridge here has two features, the value and the Kalman level, where
there is SQL to hold it against, and all features otherwise.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import skill
from ..operators import bootstrap, features, hac, inject, models, origins, profile, scores, segments, summary, trees
from ..operators.blocked import placed
from ..sources.tables import stored
from .base import DEPTH, DIST, LEN, SEGS, SEQ, STEP, H, naive_sql, placed_rows, rounded, segmented, series, split_sql, valid_sql, with_
from .base import BOUNDS as _BOUNDS
from .inference import _draw_sql, _normal_sf_sql, _pct, _t_two_sided_sql, CONDITIONS, DRAWS, SHARES  # noqa: F401
from .modelling import K, LEAST, OWN, design, kalman_sql

HORIZONS = (1, 3)
BLOCKS = (12, 25, 50)
PAIR = ["lag_0", "kalman"]


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def arm_rows(spark, d, horizon: int, names: list[str], keep: tuple[str, ...] = ("seg",), places: DataFrame | None = None) -> DataFrame:
    """The arms' rows, written once: fits, predictions, counts and tests all read them. places: placed_rows that are written already."""
    return stored(scores.arm_rows(design(placed_rows(spark, d) if places is None else places, horizon, names=names), [f"a_{n}" for n in names], [f"n_{n}" for n in names], keep), "arm-rows")


def ridge_arms(rows: DataFrame, n: int | list[int], by: list[str]) -> DataFrame:
    """Test rows with ridge predictions, a model for each group of by, on the first n features or on those of the given places."""
    xs = [f"x{k}" for k in (range(n) if isinstance(n, int) else n)]
    model = models.fit_ridge(rows.where("role = 'train'"), xs, keys=by)
    return models.predict_ridge(rows.where("role = 'test'"), model, xs, by)


def _aligned(spark, d, horizon: int, places: DataFrame) -> DataFrame:
    rows = arm_rows(spark, d, horizon, PAIR, places=places)
    predicted = stored(ridge_arms(rows, len(PAIR), [*K, "arm"]), "predicted")
    em, ep = F.col("target") - F.col("prediction"), F.col("target") - F.col("v")
    out = scores.arm_skills(predicted)
    at = lambda arm, role, x: F.when((F.col("arm") == arm) & (F.col("role") == role), x)
    counts = rows.groupBy(*K).agg(F.count(at("a", "train", 1)).alias("n_train_a"), F.count(at("c", "train", 1)).alias("n_train_c"), F.min(at("a", "test", F.col("t"))).alias("test_start"), F.max(at("a", "test", F.col("t"))).alias("test_end"))
    dm = hac.p_values(hac.diebold_mariano(predicted.where("arm <> 'b'"), em, ep, horizon, [*K, "arm"]), "dm")
    dm = dm.groupBy(*K).agg(*[F.max(F.when(F.col("arm") == a, F.col("p"))).alias(f"dm_p_{a}") for a in "ac"])
    sq = lambda arm: F.max(F.when(F.col("arm") == arm, em * em))
    wide = stored(predicted.groupBy(*K, "seg", "t").agg(sq("a").alias("em2_a"), sq("c").alias("em2_c"), F.max(ep * ep).alias("ep2"), F.max("in_a").alias("in_a")), "test-errors")
    for size in BLOCKS:
        table = bootstrap.block_sums(bootstrap.segment_blocks(wide, size), F.col("in_a"), F.lit(True), "em2_c", "ep2", em2_a="em2_a")
        ci = bootstrap.bias_of_blocks(table, DRAWS.get()[0], 7, redraws=DRAWS.get()[1])
        out = out.join(ci.select(*K, F.col("ci_lo").alias(f"ci_lo_{size}"), F.col("ci_hi").alias(f"ci_hi_{size}")), K, "left")
    out = out.join(dm, K, "left").join(counts, K, "left")
    lo, hi = F.col("ci_lo_25"), F.col("ci_hi_25")
    return out.select(
        *K, F.lit(horizon).alias("horizon"), "skill_a", "skill_b", "skill_c", F.col("total").alias("bias"), "feature", (F.col("skill_c") - F.col("skill_b")).alias("training_and_composition"),
        "dm_p_a", "dm_p_c", *[f"ci_{x}_{n}" for n in BLOCKS for x in ("lo", "hi")], ((lo > 0) | (hi < 0)).alias("excludes_zero"), ((F.col("skill_a") < 0) != (F.col("skill_c") < 0)).alias("sign_flip"),
        F.col("n_a").alias("n_test_a"), F.col("n_c").alias("n_test_c"), "n_train_a", "n_train_c", (F.col("n_c") / F.col("n_a")).alias("expansion"), "rmse_p_a", "rmse_p_c", "test_start", "test_end",
    )


def aligned_table(spark, d):
    """Main table: for each series and horizon skills of A, B and C, the bias with intervals for three block sizes, DM p-values, counts."""
    places = placed_rows(spark, d)
    segs = places.groupBy(*K).agg((F.max("seg") + 1).alias("segments"))
    return rounded(union(_aligned(spark, d, h, places) for h in HORIZONS).join(segs, K), 4)


# SQL: ridge on two standardised features in closed form, for each group
def _fit2(x1: str, x2: str, train: str, by: str = "series_id") -> str:
    return f"""SELECT {by}, my, m1, m2, CASE WHEN s1 > 0 AND s2 > 0 THEN ((n + 1) * r1 - n * c * r2) / ((n + 1) * (n + 1) - n * c * n * c) / s1 WHEN s1 > 0 THEN r1 / (n + 1) / s1 ELSE 0 END AS b1,
    CASE WHEN s1 > 0 AND s2 > 0 THEN ((n + 1) * r2 - n * c * r1) / ((n + 1) * (n + 1) - n * c * n * c) / s2 WHEN s2 > 0 THEN r2 / (n + 1) / s2 ELSE 0 END AS b2
  FROM (SELECT {by}, count(*)::DOUBLE AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg(target) AS my, stddev_pop({x1}) AS s1, stddev_pop({x2}) AS s2,
    covar_pop({x1}, {x2}) / nullif(stddev_pop({x1}) * stddev_pop({x2}), 0) AS c, count(*) * covar_pop({x1}, target) / nullif(stddev_pop({x1}), 0) AS r1, count(*) * covar_pop({x2}, target) / nullif(stddev_pop({x2}), 0) AS r2
    FROM {train} GROUP BY ALL)"""


def _calendar_sql(h: int) -> str:
    return f"""cs AS (SELECT nv.*, CASE WHEN t <= train_end AND target_t < test_start THEN 'train' WHEN t BETWEEN test_start AND test_end THEN 'test' END AS split
  FROM nv JOIN bo USING (series_id) WHERE target IS NOT NULL)"""


def pair_arms_sql(h: int, depth: int = DEPTH, seq: int = SEQ) -> list[str]:
    """aw, na: rows of both designs with v, k_aware, k_naive and split; pa, pb, pc: test rows of the arms with prediction p."""
    predict = lambda x, rows, fit: f"SELECT q.*, my + b1 * (v - m1) + b2 * ({x} - m2) AS p FROM {rows} q JOIN ({fit}) USING (series_id) WHERE split = 'test'"
    return [
        *SEGS, naive_sql(h), valid_sql(depth, seq, h), split_sql(h=h), _BOUNDS, _calendar_sql(h), *kalman_sql("seg", "seg", "ks"), *kalman_sql("0", "s", "kn"),
        "aw AS (SELECT sp.*, ks.x AS k_aware, kn.x AS k_naive FROM sp JOIN ks USING (series_id, t) JOIN kn USING (series_id, t))",
        "na AS (SELECT cs.*, kn.x AS k_naive FROM cs JOIN kn USING (series_id, t))",
        f"pa AS ({predict('k_aware', 'aw', _fit2('v', 'k_aware', '(FROM aw WHERE split = ' + chr(39) + 'train' + chr(39) + ')'))})",
        f"pb AS ({predict('k_naive', 'aw', _fit2('v', 'k_naive', '(FROM aw WHERE split = ' + chr(39) + 'train' + chr(39) + ')'))})",
        f"pc AS ({predict('k_naive', 'na', _fit2('v', 'k_naive', '(FROM na WHERE split = ' + chr(39) + 'train' + chr(39) + ')'))})",
    ]


def _dm_sql(h: int, arm: str, top: int = 40) -> list[str]:
    lags = ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, top + 1))
    terms = " + ".join(f"sum(CASE WHEN l >= {k} THEN 2 * (1 - {k} / (l + 1)) * c * c{k} ELSE 0 END)" for k in range(1, top + 1))
    return [
        f"hx{arm} AS (SELECT *, x - avg(x) OVER (PARTITION BY series_id) AS c, count(x) OVER (PARTITION BY series_id) AS n FROM (SELECT series_id, t, (target - p) * (target - p) - (target - v) * (target - v) AS x FROM p{arm}))",
        f"hl{arm} AS (SELECT *, least(n - 1, greatest(10, {h - 1}, floor(4 * pow(n / 100, 2.0 / 9))::BIGINT)) AS l, {lags} FROM hx{arm} WINDOW w AS (PARTITION BY series_id ORDER BY t))",
        f"hs{arm} AS (SELECT series_id, count(x) AS n, avg(x) AS mean, greatest(1e-12, (sum(c * c) + {terms}) / count(x) / count(x)) AS variance FROM hl{arm} GROUP BY 1)",
        f"dm{arm} AS (SELECT series_id, {_t_two_sided_sql('dm', '(n - 1)')} AS p FROM (SELECT series_id, n, sqrt(greatest(1e-12, (n + 1 - {2 * h} + {h * (h - 1)} / n) / n)) * mean / sqrt(variance) AS dm FROM hs{arm}))",
    ]


def _aligned_sql(h: int) -> str:
    sk = lambda a, where="": f"SELECT series_id, count(*) AS n, 100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))) AS skill, sqrt(avg((target - v) * (target - v))) AS rp, min(t) AS t0, max(t) AS t1 FROM p{a} GROUP BY 1"
    ctes = [*pair_arms_sql(h), *_dm_sql(h, "a"), *_dm_sql(h, "c")]
    ctes.append("wi AS (SELECT c.series_id, c.t, seg, (c.target - c.p) * (c.target - c.p) AS mc, (c.target - c.v) * (c.target - c.v) AS ep, a.ma FROM pc c LEFT JOIN (SELECT series_id, t, (target - p) * (target - p) AS ma FROM pa) a ON a.series_id = c.series_id AND a.t = c.t)")
    for n in BLOCKS:
        ctes += [
            f"tb{n} AS (SELECT series_id, dense_rank() OVER (PARTITION BY series_id ORDER BY seg, part) - 1 AS place, count(*) AS n_c, sum(mc) AS m_c, sum(ep) AS p_c, count(ma) AS n_a, coalesce(sum(ma), 0) AS m_a, coalesce(sum(ep) FILTER (ma IS NOT NULL), 0) AS p_a FROM (SELECT *, (row_number() OVER (PARTITION BY series_id, seg ORDER BY t) - 1) // {n} AS part FROM wi) GROUP BY series_id, seg, part)",
            f"tt{n} AS (SELECT series_id, count(*) AS n, sum(n_a) AS t_a, sum(n_c) AS t_c FROM tb{n} GROUP BY 1)",
            f"rp{n} AS (SELECT series_id, rep, 100 * (1 - sqrt(sum(m_c) / sum(p_c))) - 100 * (1 - sqrt(sum(m_a) / sum(p_a))) AS bias FROM (" + _draw_sql(f"tt{n}", "n", "n") + f") JOIN tb{n} USING (series_id, place) GROUP BY 1, 2 HAVING sum(n_a) >= 0.5 * max(t_a) AND sum(n_c) >= 0.5 * max(t_c))",
            f"ci{n} AS (SELECT series_id, quantile_cont(bias, 0.025) AS lo, quantile_cont(bias, 0.975) AS hi FROM rp{n} GROUP BY 1)",
        ]
    cis = ", ".join(f"round(ci{n}.lo, 4) AS ci_lo_{n}, round(ci{n}.hi, 4) AS ci_hi_{n}" for n in BLOCKS)
    joins = " ".join(f"LEFT JOIN ci{n} USING (series_id)" for n in BLOCKS)
    body = f"""SELECT series_id, {h} AS horizon, segments, round(sa.skill, 4) AS skill_a, round(sb.skill, 4) AS skill_b, round(sc.skill, 4) AS skill_c, round(sc.skill - sa.skill, 4) AS bias, round(sb.skill - sa.skill, 4) AS feature, round(sc.skill - sb.skill, 4) AS training_and_composition,
      round(da.p, 4) AS dm_p_a, round(dc.p, 4) AS dm_p_c, {cis}, ci25.lo > 0 OR ci25.hi < 0 AS excludes_zero, (sa.skill < 0) <> (sc.skill < 0) AS sign_flip, sa.n AS n_test_a, sc.n AS n_test_c, ta.n AS n_train_a, tc.n AS n_train_c,
      round(sc.n / sa.n, 4) AS expansion, round(sa.rp, 4) AS rmse_p_a, round(sc.rp, 4) AS rmse_p_c, sa.t0 AS test_start, sa.t1 AS test_end
    FROM ({sk('a')}) sa JOIN ({sk('b')}) sb USING (series_id) JOIN ({sk('c')}) sc USING (series_id) LEFT JOIN dma da USING (series_id) LEFT JOIN dmc dc USING (series_id)
      JOIN (SELECT series_id, count(*) AS n FROM aw WHERE split = 'train' GROUP BY 1) ta USING (series_id) JOIN (SELECT series_id, count(*) AS n FROM na WHERE split = 'train' GROUP BY 1) tc USING (series_id)
      JOIN (SELECT series_id, count(DISTINCT seg) AS segments FROM seg GROUP BY 1) USING (series_id) {joins}"""
    return with_(ctes, body, True)


def pair_decomposition(spark, d):
    """Four arms and their decomposition by ridge on value and Kalman level, for each horizon."""
    places = placed_rows(spark, d)
    each = (scores.arm_skills(ridge_arms(arm_rows(spark, d, h, PAIR, places=places), 2, [*K, "arm"])).withColumn("horizon", F.lit(h)) for h in HORIZONS)
    return rounded(union(each).select(*K, "horizon", *[f"skill_{x}" for x in "abcd"], "feature", "training", "composition", "total", "n_a", "n_c"), 4)


def _pair_sql(h: int, depth: int = DEPTH) -> str:
    sk = lambda a, where="": f"SELECT series_id, count(*) AS n, 100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))) AS skill FROM p{a} {where} GROUP BY 1"
    return with_(pair_arms_sql(h, depth, min(SEQ, depth + 1)), f"""SELECT series_id, {h} AS horizon, round(a.skill, 4) AS skill_a, round(b.skill, 4) AS skill_b, round(c.skill, 4) AS skill_c, round(d.skill, 4) AS skill_d, round(b.skill - a.skill, 4) AS feature, round(d.skill - b.skill, 4) AS training, round(c.skill - d.skill, 4) AS composition, round(c.skill - a.skill, 4) AS total, a.n AS n_a, c.n AS n_c
    FROM ({sk('a')}) a JOIN ({sk('b')}) b USING (series_id) JOIN ({sk('c')}) c USING (series_id) JOIN ({sk('c', 'WHERE (series_id, t) IN (SELECT (series_id, t) FROM pa)')}) d USING (series_id)""", True)


DEPTHS = (5, 10, 15)


def depth_arms(spark, d):
    """Arms by feature depth, the embargo the same for all: how the bias grows with the rows that a deeper window takes away."""
    seg, out = placed_rows(spark, d), []
    for w in DEPTHS:
        rows = origins.both_splits(features.both_designs(seg, w, min(SEQ, w + 1), H), SEQ, H, embargo=SEQ + H, **LEAST)
        long = stored(scores.arm_rows(rows, ["a_lag_0", "a_kalman"], ["n_lag_0", "n_kalman"]), "depth-rows")
        out.append(scores.arm_skills(ridge_arms(long, 2, [*K, "arm"])).withColumn("w", F.lit(w)))
    return rounded(union(out).select(*K, "w", *[f"skill_{x}" for x in "abcd"], "feature", "training", "composition", "total", "n_a", "n_c"), 4)


def _depth_sql(w: int) -> str:
    return _pair_sql(H, w).replace(f"{H} AS horizon", f"{w} AS w", 1)


def mixture_table(spark, d):
    """The decomposition beside the main table's counts and errors: exposure, persistence ratio, composition, for each series and horizon."""
    places, parts, main = placed_rows(spark, d), [], []
    columns = [f"{x}_{n}" for x in "an" for n in PAIR]
    for h in HORIZONS:
        rows = stored(design(places, h, names=PAIR).select(*K, "t", "v", "target", "split_a", "split_c", *columns), "design")  # read by fits, scores and counts
        long = scores.arm_rows(rows, columns[: len(PAIR)], columns[len(PAIR) :])
        parts.append(scores.arm_skills(ridge_arms(long, len(PAIR), [*K, "arm"])).withColumn("horizon", F.lit(h)))
        main.append(split_errors(rows).withColumn("horizon", F.lit(h)))
    joined = union(parts).join(union(main), [*K, "horizon"], "left")
    return rounded(joined.select(*K, "horizon", "composition", "total", "f", "rp_ratio", (F.col("rmse_m_c") / F.col("rmse_m_a")).alias("rm_ratio")), 4)


def split_errors(rows: DataFrame) -> DataFrame:
    """f and rp_ratio of each series: how much of C's test rows A lacks, and persistence's error on C's rows over that on A's. No model is
    needed: rows are those of `design`."""
    e = F.col("target") - F.col("v")
    part = lambda c, x: F.when(F.col(c) == "test", x)
    m = rows.groupBy(*K).agg(*[F.count(part(f"split_{a}", e)).alias(f"n_{a}") for a in "ac"], *[F.sqrt(F.avg(part(f"split_{a}", e * e))).alias(f"rp_{a}") for a in "ac"])
    return m.where("n_a > 0").select(*K, (1 - F.col("n_a") / F.col("n_c")).alias("f"), (F.col("rp_c") / F.col("rp_a")).alias("rp_ratio"))


def _mixture_sql(h: int) -> str:
    e = lambda a, where="": f"SELECT series_id, count(*) AS n, sqrt(avg((target - p) * (target - p))) AS rm, sqrt(avg((target - v) * (target - v))) AS rp FROM p{a} {where} GROUP BY 1"
    sk = lambda x: f"100 * (1 - {x}.rm / {x}.rp)"
    return with_(pair_arms_sql(h), f"SELECT series_id, {h} AS horizon, round({sk('c')} - {sk('d')}, 4) AS composition, round({sk('c')} - {sk('a')}, 4) AS total, round(1 - a.n / c.n, 4) AS f, round(c.rp / a.rp, 4) AS rp_ratio, round(c.rm / a.rm, 4) AS rm_ratio FROM ({e('a')}) a JOIN ({e('c')}) c USING (series_id) JOIN ({e('c', 'WHERE (series_id, t) IN (SELECT (series_id, t) FROM pa)')}) d USING (series_id)", True)


MODELS = ("ridge", "boosted", "forest")
#: Those whose bias is also taken apart into channels where the models are compared.
DECOMPOSED = ("ridge", "boosted")


def _predicted(rows: DataFrame, model: str, n: int, by: list[str], keep: tuple[str, ...] = ("t", "v", "target", "in_a")) -> DataFrame:
    if model == "ridge":
        return ridge_arms(rows, n, by)
    return trees.predict_by_record(rows, [f"x{k}" for k in range(n)], model, by, keep=keep, **(trees.BOOSTED if model == "boosted" else trees.FOREST))


def model_arms(spark, d):
    """Arms on all features by ridge, boosted trees and a forest, a model for each record and arm."""
    names = features.feature_names(DEPTH)
    rows = arm_rows(spark, d, H, names, ())
    each = (scores.arm_skills(_predicted(rows, m, len(names), [*K, "arm"])).withColumn("model", F.lit(m)) for m in MODELS)
    return rounded(union(each).select(*K, "model", *[f"skill_{x}" for x in "abcd"], "feature", "training", "composition", "total", "n_a", "n_c"), 4)


def model_agreement(spark, d):
    """Whether ridge, boosted trees and a forest give the bias one sign (n: models that give one), for each series, with the channels of the bias by ridge and
    boosted trees: mean absolute values, pooled over the two, and their shares."""
    names = features.feature_names(DEPTH)
    rows = arm_rows(spark, d, H, names, ())
    parts = {m: scores.arm_skills(_predicted(rows if m in DECOMPOSED else rows.where("arm <> 'b'"), m, len(names), [*K, "arm"])) for m in MODELS}  # a bias needs A and C only
    each = stored(union(p.select(*K, "feature", "training", "composition", "total", F.lit(m).alias("model")) for m, p in parts.items()), "models")
    signs = F.countDistinct(F.when(F.col("total").isNotNull(), summary.sign(F.col("total"))))
    agree = each.groupBy(*K).agg(F.count("total").alias("n"), F.min("total").alias("least"), F.max("total").alias("most"), F.when(signs > 0, signs == 1).alias("agree"))
    shares = scores.channel_shares(each.where(F.col("model").isin(*DECOMPOSED)), K).where("method = 'mean_abs'").drop("method")
    return rounded(agree.join(shares, K, "left"), 4)


#: Depth, trees and rate of the parameter grid; the slowest corner is left out. Fixed values.
GRID = [(depth, n, rate) for depth in (3, 6, 9) for n in (150, 300) for rate in (0.05, 0.1) if (n, rate) != (300, 0.1)]
SEEDS = range(10)


def _cells(rows: DataFrame, cells: list[dict], by: list[str]) -> DataFrame:
    """Rows of each arm once for each cell of parameters, which become keys."""
    made = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in cells]))
    return rows.withColumn("_cell", made).select("*", "_cell.*").drop("_cell")


def _in_cells(rows: DataFrame, cells: list[dict], n: int, by: list[str], keep: tuple[str, ...]) -> DataFrame:
    """Test rows with predictions of boosted trees in every cell of parameters, which become keys, and `cell`, the cell's place in the list. Cells that
    differ in nothing but their number of trees are stages of one fit."""
    given, longest = tuple(cells[0]), {}
    for c in cells:
        other = tuple(v for k, v in c.items() if k != "trees")
        longest[other] = max(longest.get(other, c), c, key=lambda x: x.get("trees", 0))
    stages = tuple(sorted({c["trees"] for c in cells})) if "trees" in given else ()
    fixed = {k: v for k, v in trees.BOOSTED.items() if k not in given}
    keys = [*by, *given]
    made = trees.predict_by_record(_cells(rows, [*longest.values()], keys), [f"x{k}" for k in range(n)], "boosted", keys, keep=keep, given=given, stages=stages, **fixed)
    of = F.coalesce(*[F.when(reduce(lambda x, y: x & y, [F.col(k) == F.lit(v) for k, v in c.items()]), place) for place, c in enumerate(cells)])
    return made.withColumn("cell", of).where("cell is not null")


def _boosted_bias(rows: DataFrame, cells: list[dict], n: int) -> DataFrame:
    given = tuple(cells[0])
    made = _in_cells(rows.where("arm <> 'b'"), cells, n, [*K, "arm"], ("t", "v", "target", "in_a"))
    return scores.arm_skills(made, [*K, *given]).select(*K, *given, "skill_a", "skill_c", F.col("total").alias("bias"))


def seed_spread(spark, d):
    """Bias of boosted trees over ten seeds: extremes, mean, deviation, one sign."""
    names = features.feature_names(DEPTH)
    return rounded(summary.spread(_boosted_bias(arm_rows(spark, d, H, names, ()), [{"seed": s} for s in SEEDS], len(names)), "bias", K), 4)


def parameter_grid(spark, d):
    """Bias of boosted trees over the grid of depth, number and rate."""
    names = features.feature_names(DEPTH)
    cells = [{"depth": a, "trees": b, "rate": c} for a, b, c in GRID]
    return rounded(_boosted_bias(arm_rows(spark, d, H, names, ()), cells, len(names)), 4)


def tuned_cell(spark, d):
    """For each series the cell of the grid with the least error on the last fifth of A's training rows (after an embargo), the first of equals."""
    names = features.feature_names(DEPTH)
    rows = arm_rows(spark, d, H, names, ()).where("arm = 'a' and role = 'train'").drop("role")
    part = origins.tuning_split(rows, SEQ + H).withColumn("role", F.when(F.col("part") == "fit", "train").when(F.col("part") == "validate", "test")).where("role is not null")
    cells = [{"depth": a, "trees": b, "rate": c} for a, b, c in GRID]
    made = _in_cells(part, cells, len(names), K, ("t", "v", "target"))
    e = F.col("target") - F.col("prediction")
    errors = made.groupBy(*K, "cell", "depth", "trees", "rate").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return rounded(summary.best_of(errors, "rmse", ["cell"], K), 4)


def clark_west_arms(spark, d):
    """Clark-West of ridge against persistence in arms A and C."""
    predicted = ridge_arms(arm_rows(spark, d, H, PAIR), 2, [*K, "arm"]).where("arm <> 'b'")
    s = hac.clark_west(predicted, F.col("target"), F.col("v"), F.col("prediction"), H, [*K, "arm"])
    return rounded(hac.p_values(s, "cw").select(*K, "arm", "n", "cw", "p"), 4)


def _cw_sql() -> str:
    ctes = pair_arms_sql(H)
    for arm in "ac":
        ctes += [c.replace("(target - p) * (target - p) - (target - v) * (target - v)", "(target - v) * (target - v) - ((target - p) * (target - p) - (v - p) * (v - p))") for c in _dm_sql(H, arm)[:3]]
    return with_(ctes, " UNION ALL ".join(f"SELECT series_id, '{a}' AS arm, n, round(z, 4) AS cw, round({_normal_sf_sql('z')}, 4) AS p FROM (SELECT series_id, n, mean / sqrt(variance) AS z FROM hs{a})" for a in "ac"), True)


def channel_lead_times(spark, d):
    """Composition by lead time: valid, input-only and target-crossing rows, skills D, E and C, for each horizon."""
    out = []
    for h in HORIZONS:
        predicted = ridge_arms(arm_rows(spark, d, h, PAIR, ("target_t",)), 2, [*K, "arm"]).where("arm = 'c'")
        out.append(scores.lead_time_channels(predicted, h, STEP).withColumn("horizon", F.lit(h)))
    return rounded(union(out), 4)


def _lead_sql(h: int) -> str:
    em, ep = "(target - p) * (target - p)", "(target - v) * (target - v)"
    sk = lambda w: f"100 * (1 - sqrt(sum({em}) FILTER ({w}) / sum({ep}) FILTER ({w})))"
    rho = lambda w, e: f"sqrt(avg({e}) FILTER ({w})) / sqrt(avg({e}) FILTER (ok))"
    i, c = "NOT ok AND NOT late", "NOT ok AND late"
    inner = f"SELECT series_id, count(*) FILTER (ok) AS n_valid, count(*) FILTER ({i}) AS n_input_only, count(*) FILTER ({c}) AS n_target_crossing, {rho(i, ep)} AS rho_p_input_only, {rho(i, em)} AS rho_m_input_only, {rho(c, ep)} AS rho_p_target_crossing, {rho(c, em)} AS rho_m_target_crossing, {sk('ok')} AS d, {sk(f'ok OR ({i})')} AS e, {sk('true')} AS c FROM (SELECT *, (series_id, t) IN (SELECT (series_id, t) FROM pa) AS ok, target_t - t <> {h * STEP} AS late FROM pc) GROUP BY 1"
    rounds = ", ".join(f"round({n}, 4) AS {n}" for n in ("rho_p_input_only", "rho_m_input_only", "rho_p_target_crossing", "rho_m_target_crossing"))
    return with_(pair_arms_sql(h), f"SELECT series_id, {h} AS horizon, n_valid, n_input_only, n_target_crossing, {rounds}, round(d, 4) AS skill_d, round(e, 4) AS skill_e, round(c, 4) AS skill_c, round(c - d, 4) AS comp_total, round(e - d, 4) AS comp_input_only, round(c - e, 4) AS comp_target_crossing FROM ({inner})", True)


# --- walk-forward gap profile ---------------------------------------------------------------------------------------


def _walk_forward(spark, d) -> DataFrame:
    """Rows scored out of sample: ridge on value and 5-row mean, fitted on all blocks before the row's own, with distances from gaps."""
    from .base import naive_rows

    rows = origins.walk_forward(naive_rows(spark, d).where("target is not null and m5 is not null"))
    fold = F.explode(F.expr("transform(sequence(1, 5), f -> struct(f AS fold, CASE WHEN block = f THEN 'test' WHEN block < f THEN 'train' END AS role))"))
    folded = rows.select("series_id", "t", "v", "target", "displaced", F.col("v").alias("x0"), F.col("m5").alias("x1"), "block", fold.alias("_f")).select("*", "_f.*").where("role is not null").drop("_f", "block")
    scored = ridge_arms(stored(folded, "folds"), 2, [*K, "fold"])
    dist = segments.gap_distance(series(spark, d), STEP).select("series_id", "t", "d", "gap_before", "to_gap")
    em, ep = F.col("target") - F.col("prediction"), F.col("target") - F.col("v")
    out = scored.join(dist, ["series_id", "t"]).select("series_id", "t", "fold", "displaced", "d", "gap_before", "to_gap", (em * em).alias("sq_m"), (ep * ep).alias("sq_p"), (em * em).alias("sq"))
    return stored(out, "walk-forward")


def walk_forward_profile(spark, d):
    """Model error by distance from the last gap, from rows scored out of sample, over the error of rows that no gap touches."""
    return rounded(profile.distance_profile(_walk_forward(spark, d), 8, H, least=3), 4)


def walk_forward_inflation(spark, d):
    """Inflation of model and persistence right after a gap, and their ratio, from rows scored out of sample."""
    return rounded(profile.first_after_gap(_walk_forward(spark, d), 8, H, least_far=20), 4)


_WALK = [
    *SEGS, naive_sql(), LEN, DIST,
    "wb AS (SELECT *, least((row_number() OVER (PARTITION BY series_id ORDER BY t) - 1) // greatest(1, count(*) OVER (PARTITION BY series_id) // 6), 5) AS block FROM nv WHERE target IS NOT NULL AND m5 IS NOT NULL)",
    "wt AS (SELECT series_id, f.fold, v, m5, target FROM wb, (SELECT unnest(range(1, 6)) AS fold) f WHERE block < f.fold)",
    f"wf AS ({_fit2('v', 'm5', 'wt', 'series_id, fold')})",
    "ws AS (SELECT wb.*, my + b1 * (v - m1) + b2 * (m5 - m2) AS p FROM wb JOIN wf ON wf.series_id = wb.series_id AND wf.fold = wb.block)",
    "wx AS (SELECT ws.series_id, ws.t, displaced, d, gap_before, to_gap, (target - p) * (target - p) AS sq_m, (target - ws.v) * (target - ws.v) AS sq_p FROM ws JOIN di USING (series_id, t))",
]
_FAR = f"(d > 8 AND NOT displaced AND to_gap > {H})"


# --- rolling origins with refits ------------------------------------------------------------------------------------


def rolling_origin_refit(spark, d):
    """refitted_origins with guards for the small tables' series."""
    return refitted_origins(spark, d, 40, 5)


def refitted_origins(spark, d, least: int = 1200, least_test: int = 200):
    """For six disjoint origins: A and C refitted on what lies before each, ridge on value and Kalman level; A needs so many rows to train and test."""
    rows = features.both_designs(placed_rows(spark, d), DEPTH, SEQ, H)
    places = origins.numbered(series(spark, d)).select("series_id", F.col("_r").alias("place"), F.col("t").alias("at"))
    w = origins.origin_windows(series(spark, d)).select("series_id", "origin", F.col("start").alias("place"), (F.col("end") - 1).alias("last"))
    w = w.join(places, ["series_id", "place"]).withColumnRenamed("at", "t0").join(places.withColumnRenamed("place", "last").withColumnRenamed("at", "t1"), ["series_id", "last"]).select("series_id", "origin", "t0", "t1")
    each = rows.join(w, "series_id")
    train, test = (F.col("target_t") < F.col("t0")), F.col("t").between(F.col("t0"), F.col("t1"))
    role = F.when(train, "train").when(test, "test")
    each = each.withColumn("split_c", role).withColumn("split_a", F.when(F.col("valid"), role))
    keys = [*K, "origin"]
    long = stored(scores.arm_rows(each, ["a_lag_0", "a_kalman"], ["n_lag_0", "n_kalman"], keys=keys), "origin-rows")
    enough = long.where("arm = 'a'").groupBy(*keys).agg(F.count(F.when(F.col("role") == "train", 1)).alias("n_train"), F.count(F.when(F.col("role") == "test", 1)).alias("n_test")).where((F.col("n_train") >= least) & (F.col("n_test") >= least_test)).select(*keys)
    long = long.join(enough, keys, "left_semi")
    got = scores.arm_skills(ridge_arms(long, 2, [*keys, "arm"]), keys)
    return rounded(got.select(*keys, "skill_a", "skill_c", F.col("total").alias("bias"), "n_a", "n_c"), 4)


_REFIT = [
    *SEGS, naive_sql(), valid_sql(), *kalman_sql("seg", "seg", "ks"), *kalman_sql("0", "s", "kn"),
    "pl AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM s)",
    "ow AS (SELECT a.series_id, o AS origin, a.t AS t0, b.t AS t1 FROM (SELECT unnest(range(1, 7)) AS o), pl a, pl b WHERE a.series_id = b.series_id AND a.r = a.n // 2 + a.n // 12 * (o - 1) AND b.r = a.n // 2 + a.n // 12 * o - 1)",
    "ro AS (SELECT nv.*, origin, kn.x AS k_naive, ks.x AS k_aware, va.t IS NOT NULL AS valid, CASE WHEN nv.target_t < t0 THEN 'train' WHEN nv.t BETWEEN t0 AND t1 THEN 'test' END AS split FROM nv JOIN ow USING (series_id) JOIN kn USING (series_id, t) JOIN ks USING (series_id, t) LEFT JOIN va USING (series_id, t) WHERE nv.target IS NOT NULL)",
    "ra AS (SELECT * FROM ro WHERE valid AND split IS NOT NULL AND (series_id, origin) IN (SELECT (series_id, origin) FROM ro WHERE valid GROUP BY series_id, origin HAVING count(*) FILTER (split = 'train') >= 40 AND count(*) FILTER (split = 'test') >= 5))",
    "rc AS (SELECT * FROM ro WHERE split IS NOT NULL AND (series_id, origin) IN (SELECT (series_id, origin) FROM ra))",
    f"qa AS (SELECT q.*, my + b1 * (v - m1) + b2 * (k_aware - m2) AS p FROM ra q JOIN ({_fit2('v', 'k_aware', '(SELECT * FROM ra WHERE split = ' + chr(39) + 'train' + chr(39) + ')', 'series_id, origin')}) USING (series_id, origin) WHERE split = 'test')",
    f"qc AS (SELECT q.*, my + b1 * (v - m1) + b2 * (k_naive - m2) AS p FROM rc q JOIN ({_fit2('v', 'k_naive', '(SELECT * FROM rc WHERE split = ' + chr(39) + 'train' + chr(39) + ')', 'series_id, origin')}) USING (series_id, origin) WHERE split = 'test')",
]


# --- injection sweep ------------------------------------------------------------------------------------------------

FRACTIONS = (0.6, 0.7, 0.8)
PLACEMENTS = (0, 1)


#: Tables of injected copies that the sweeps of one job share, by what they were made for; None outside of sharing_copies.
COPIES: ContextVar[dict | None] = ContextVar("COPIES", default=None)


@contextmanager
def sharing_copies():
    """Sweeps made within read the same intact series and copies, which are made once for the same placements."""
    token = COPIES.set({} if COPIES.get() is None else COPIES.get())
    try:
        yield
    finally:
        COPIES.reset(token)


def _once(key, make):
    made = {} if COPIES.get() is None else COPIES.get()
    if key not in made:
        made[key] = make()
    return made[key]


def injected_copies(intact: DataFrame, placements: tuple[int, ...] = PLACEMENTS) -> tuple[DataFrame, DataFrame]:
    """Copies of each series with exact gaps, every run a series of its own: placed rows (rid, t, v and places), and one row for each run (rid, run,
    record, condition, share, placement, n_whole, base_segments; rid div the number of cells is the record's number). Copies that their gaps
    found no room in are left out: they would be intact records under an injected run's name.

    intact: placed rows. They are numbered already, so gaps meet them by place, a row for each place with the cells that lose it, before copies are made.
    """
    cells = [{"cell": i, "condition": c, "nominal": n, "share": s, "placement": p} for i, (c, n, s, p) in enumerate((*c, s, p) for c in CONDITIONS for s in SHARES for p in placements)]
    listed = intact.groupBy(F.col("series_id").alias("record")).agg(F.max("_c").alias("n"), (F.max("seg") + 1).alias("base_segments")).withColumn("_id", F.monotonically_increasing_id())
    listed = stored(listed, "records")  # numbers stay as they are written
    runs = listed.withColumn("_cell", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in cells]))).select("*", "_cell.*").drop("_cell")
    runs = runs.withColumn("run", F.concat_ws("/", "record", "condition", F.col("share").cast("string"), F.col("placement").cast("string")))
    keys = ["run", "record", "condition", "share", "placement", "nominal"]
    plan = inject.plan_gaps(runs, F.floor(F.col("n") * F.col("share")), F.col("nominal"), 5, 20, keys)
    plan = stored(plan.join(runs.select("run", "cell"), "run").select("record", "cell", "start", "length"), "gap-plan")
    lost = plan.select("record", "cell", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("_r"))
    lost = lost.groupBy("record", "_r").agg(F.collect_list("cell").alias("_lost"))
    made = listed.select("record", "_id").join(plan.groupBy("record").agg(F.collect_set("cell").alias("_cells")), "record")
    s = intact.select(F.col("series_id").alias("record"), "t", "v", "_r").join(made, "record").join(lost, ["record", "_r"], "left")
    left = F.explode(F.array_except("_cells", F.coalesce("_lost", F.array().cast("array<int>"))))
    s = s.select("_id", "t", "v", left.alias("cell")).select((F.col("_id") * len(cells) + F.col("cell")).alias("rid"), "t", "v")
    rows = stored(placed(stored(s, "injected"), STEP, ["rid"]), "injected-segments")
    return rows, runs.select((F.col("_id") * len(cells) + F.col("cell")).alias("rid"), "run", "record", "condition", "share", "placement", F.col("n").alias("n_whole"), "base_segments")


def injection_sweep(spark, d, horizon: int = H, placements: tuple[int, ...] = PLACEMENTS, names: list[str] = PAIR, least: int = 40, least_test: int = 5, models: dict[str, list[str]] | None = None):
    """For every injected copy and origin: rows, errors, skills and bias of A and C by ridge, in skill and in RMSE above persistence's, beside
    the intact record's, and whether the run is reliable. Origins are windows of the intact record; guards on rows as in the evaluation.
    models: names of models, which become a column, and the features (of names) of each; all are fitted to the same rows.

    Rows are read once: fits and errors both come from the moments of each run's, origin's and arm's training and test rows."""
    intact = _once(("intact", d), lambda: placed_rows(spark, d))
    seg, runs = _once((d, placements), lambda: injected_copies(intact, placements))
    rows = features.both_designs(seg, DEPTH, SEQ, horizon, ["rid"])
    w = origins.origin_bounds(intact.select("series_id", "t", "v"), list(FRACTIONS), SEQ, horizon).select(F.col("series_id").alias("record"), "fraction", "train_end", "test_start", "test_end").dropna()
    w = stored(w, "windows")
    ends = F.collect_list(F.struct("fraction", "train_end", "test_start", "test_end"))
    each = rows.join(runs.select("rid", "record").join(w, "record").groupBy("rid").agg(ends.alias("_w")), "rid").withColumn("_w", F.explode("_w")).select("*", "_w.*")
    test = F.col("t").between(F.col("test_start"), F.col("test_end"))
    each = each.withColumn("split_a", F.when(F.col("valid") & (F.col("t") <= F.col("train_end")), "train").when(F.col("valid") & test, "test"))
    each = each.withColumn("split_c", F.when((F.col("t") <= F.col("train_end")) & (F.col("target_t") < F.col("test_start")), "train").when(test, "test"))
    long = scores.arm_rows(each, [f"a_{n}" for n in names], [f"n_{n}" for n in names], keys=["rid", "fraction"], only="ac")
    own = {"": names} if models is None else models
    facts = stored(ridge_moments(long, {m: [f"x{names.index(n)}" for n in x] for m, x in own.items()}, ["rid", "fraction"]), "moments")
    enough = facts.where(" and ".join(f"n_train_{a} >= {least} and n_test_{a} >= {least_test}" for a in "ac"))
    parts = (arm_errors(enough, m).withColumn("model", F.lit(m)) for m in own)
    got = union(parts) if models is not None else union(parts).drop("model")
    got = got.withColumns({f"excess_{a}": F.col(f"rmse_m_{a}") - F.col(f"rmse_p_{a}") for a in "ac"}).withColumn("rmse_bias", F.col("excess_c") - F.col("excess_a"))
    gaps = seg.groupBy("rid").agg(F.max("_c").alias("n_left"), (F.max("seg") + 1).alias("segments"))
    got = got.join(runs, "rid").join(gaps, "rid").join(intact_errors(spark, d, w, horizon, rows=intact), ["record", "fraction"], "left").drop("rid")
    got = got.withColumn("missing", 1 - F.col("n_left") / F.col("n_whole")).withColumn("mean_gap", (F.col("n_whole") - F.col("n_left")) / F.greatest(F.lit(1), F.col("segments") - F.col("base_segments")))
    ratio = F.col("rmse_p_a") / F.col("rmse_p_intact")
    return got.withColumn("rp_ratio", ratio).withColumn("reliable", summary.reliable(F.col("skill_a"), ratio)).drop("n_left", "n_whole", "segments", "base_segments")


def ridge_moments(rows: DataFrame, own: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """keys, and for arms A and C their rows (n_train_a, n_test_a, ...) and, for each model, the moments of training and test rows
    (train_a_MODEL, ...), in one aggregate. rows: arm_rows; own: the columns of each model's features."""
    got = rows.groupBy(*keys, "arm", "role").agg(F.count("*").alias("n"), *[models.moments([*xs, "target"], F.col("role") == "train", F.col("target") - F.col("v")).alias(f"m_{m}") for m, xs in own.items()])
    at = lambda arm, role, x: F.max(F.when((F.col("arm") == arm) & (F.col("role") == role), F.col(x)))
    pairs = [(a, r) for a in "ac" for r in ("train", "test")]
    return got.groupBy(*keys).agg(*[F.coalesce(at(a, r, "n"), F.lit(0)).alias(f"n_{r}_{a}") for a, r in pairs], *[at(a, r, f"m_{m}").alias(f"{r}_{a}_{m}") for m in own for a, r in pairs])


def arm_errors(facts: DataFrame, model: str) -> DataFrame:
    """rid, fraction and of arms A and C: rows, errors, skills, and their difference as bias, by one model of ridge_moments."""
    out = facts.select("rid", "fraction", *[f"{r}_{a}_{model}" for a in "ac" for r in ("train", "test")])
    for a in "ac":
        train, test = f"train_{a}_{model}", f"test_{a}_{model}"
        fitted = (F.col(f"{train}.n") > 0) & (F.col(f"{test}.n") > 0)
        out = out.withColumn(f"_m_{a}", models.ridge_error(train, test)).withColumn(f"_p_{a}", F.when(fitted, F.col(f"{test}.square")))
        out = out.withColumns({f"n_{a}": F.coalesce(F.when(fitted, F.col(f"{test}.n")), F.lit(0)), f"rmse_p_{a}": F.sqrt(f"_p_{a}"), f"rmse_m_{a}": F.sqrt(f"_m_{a}"), f"skill_{a}": skill(F.col(f"_m_{a}"), F.col(f"_p_{a}"))})
    out = out.where("n_a > 0 or n_c > 0").withColumn("bias", F.col("skill_c") - F.col("skill_a"))
    return out.select("rid", "fraction", *[f"{x}_{a}" for a in "ac" for x in ("n", "rmse_p", "rmse_m", "skill")], "bias")


def intact_errors(spark, d, w: DataFrame, horizon: int = H, least: int = 5, rows: DataFrame | None = None) -> DataFrame:
    """record, fraction, rmse_p_intact: persistence error of the intact record in each origin's test window; at least so many rows.
    rows: the series, where they are written already."""
    rows = (series(spark, d) if rows is None else rows).select(F.col("series_id").alias("record"), "t", "v")
    rows = features.with_target(rows, horizon, ["record"]).where("target is not null")
    e = F.col("target") - F.col("v")
    return rows.join(w, "record").where(F.col("t").between(F.col("test_start"), F.col("test_end"))).groupBy("record", "fraction").agg(F.sqrt(F.avg(e * e)).alias("rmse_p_intact"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")


def injection_runs(spark, d):
    s = injection_sweep(spark, d)
    return rounded(s.select("record", "condition", "share", "placement", "fraction", "n_a", "n_c", "rmse_p_a", "rmse_m_a", "rmse_p_c", "rmse_m_c", "skill_a", "skill_c", "bias", "rmse_p_intact", "reliable"), 4)


def injection_mixture(spark, d):
    """The mixture identity on injected runs: exposure, error ratios of displaced rows, the bias they give, and the exposure by design."""
    m = scores.injection_mixture(injection_sweep(spark, d), DEPTH, F.lit(H))
    return rounded(m.select("record", "condition", "share", "placement", "fraction", "f", "rho_p", "rho_m", "bias_hat", "f_design"), 4)


def injection_pooled(spark, d):
    """Mean bias by condition, over all runs and over reliable ones, with the share of runs that are reliable."""
    s = injection_sweep(spark, d)
    ok = F.when(F.col("reliable"), F.col("bias"))
    return rounded(s.groupBy("condition").agg(F.count("*").alias("n"), F.avg("bias").alias("mean"), F.percentile("bias", 0.5).alias("median"), F.count(ok).alias("n_reliable"), F.avg(ok).alias("mean_reliable")), 4)


def sweep_sql(h: int = H, pair: bool = True) -> list[str]:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS condition, {n} AS nominal, {s}::DOUBLE AS share, {p} AS placement" for c, n in CONDITIONS for s in SHARES for p in PLACEMENTS)
    name = "run || '/' || record || '/' || condition || '/' || share || '/' || placement || '/' || nominal"
    hashed = lambda seed: f"('0x' || substr(md5('{seed}|' || {name} || '|' || j), 1, 8))::UBIGINT::BIGINT"
    train = lambda where: f"(SELECT * FROM sw WHERE {where} = 'train')"
    one = lambda x, where: f"SELECT run, record, fraction, avg(target) AS my, avg(v) AS m1, avg({x}) AS m2, 0 AS b1, CASE WHEN var_pop({x}) > 0 THEN count(*) * covar_pop({x}, target) / (count(*) * var_pop({x}) + var_pop({x})) ELSE 0 END AS b2 FROM {train(where)} GROUP BY ALL"
    fit = lambda x, where: _fit2("v", x, train(where), "run, record, fraction") if pair else one(x, where)
    sums = lambda a, x: f"e{a} AS (SELECT run, record, fraction, count(*) AS n, sqrt(avg((target - v) * (target - v))) AS rp, sqrt(avg((target - p) * (target - p))) AS rm FROM (SELECT q.*, my + b1 * (v - m1) + b2 * ({x} - m2) AS p FROM sw q JOIN ({fit(x, f'split_{a}')}) USING (run, record, fraction) WHERE split_{a} = 'test') GROUP BY 1, 2, 3)"
    return [
        *SEGS[:2], f"cells AS ({cells})",
        "rs AS (SELECT series_id AS record, t, v, c.*, series_id || '/' || condition || '/' || share || '/' || placement AS run FROM s, cells c)",
        "pn AS (SELECT *, greatest(1, round_even(dr / nominal::DOUBLE, 0))::BIGINT AS g FROM (SELECT *, floor(n * share)::BIGINT AS dr FROM (SELECT run, record, condition, share, placement, nominal, count(*) AS n FROM rs GROUP BY ALL)))",
        "pj AS (SELECT *, unnest(range(0, g)) AS j FROM (SELECT *, n - dr - 42 - (g - 1) AS room FROM pn) WHERE dr >= g AND room >= 0)",
        f"pc AS (SELECT *, {hashed(5)} % (room + 1) AS cut, {hashed(6)} % 2147483648 AS turn FROM pj)",
        "pl AS (SELECT *, dr // g + CASE WHEN row_number() OVER (PARTITION BY run ORDER BY turn, j) <= dr % g THEN 1 ELSE 0 END AS length FROM pc)",
        "ps AS (SELECT run, length, 21 + cut + row_number() OVER w - 1 + coalesce(sum(length) OVER (PARTITION BY run ORDER BY cut, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pl WINDOW w AS (PARTITION BY run ORDER BY cut, j))",
        "rg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t) - 1 AS i FROM rs WHERE run IN (SELECT run FROM ps)) ANTI JOIN (SELECT run, unnest(range(start::BIGINT, (start + length)::BIGINT)) AS i FROM ps) USING (run, i))",
        f"sg AS (SELECT * EXCLUDE (b), sum(b) OVER (PARTITION BY run ORDER BY t) AS seg FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY run ORDER BY t) <> {STEP} THEN 1 ELSE 0 END AS b FROM rg))",
        *[c.replace("series_id", "run") for c in kalman_sql("seg", "sg", "ks")], *[c.replace("series_id", "run") for c in kalman_sql("0", "sg", "kn")],
        f"nv AS (SELECT * FROM (SELECT *, lead(v, {h}) OVER (PARTITION BY run ORDER BY t) AS target, lead(t, {h}) OVER (PARTITION BY run ORDER BY t) AS target_t, row_number() OVER (PARTITION BY run, seg ORDER BY t) - 1 AS p0, count(*) OVER (PARTITION BY run, seg) AS m0 FROM sg) WHERE target IS NOT NULL)",
        "bn AS (SELECT series_id AS record, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM s)",
        f"bf AS (SELECT *, least(n - 1, i_start + floor(0.25 * n)::BIGINT) AS i_end FROM (SELECT *, i_train + {SEQ + h} AS i_start FROM (SELECT record, n, fraction, floor(fraction * n)::BIGINT AS i_train FROM (SELECT record, max(n) AS n, unnest([{', '.join(f'{f}::DOUBLE' for f in FRACTIONS)}]) AS fraction FROM bn GROUP BY 1))))",
        "bw AS (SELECT f.record, fraction, a.t AS train_end, b.t AS test_start, c.t AS test_end FROM bf f JOIN bn a ON a.record = f.record AND a.r = i_train JOIN bn b ON b.record = f.record AND b.r = i_start JOIN bn c ON c.record = f.record AND c.r = i_end)",
        f"sx AS (SELECT nv.*, fraction, ks.x AS k_aware, kn.x AS k_naive, p0 >= {max(DEPTH, SEQ - 1)} AND m0 - p0 - 1 >= {h} AS valid, train_end, test_start, test_end FROM nv JOIN bw USING (record) JOIN ks USING (run, t) JOIN kn USING (run, t))",
        "sy AS (SELECT *, CASE WHEN valid AND t <= train_end THEN 'train' WHEN valid AND t BETWEEN test_start AND test_end THEN 'test' END AS split_a, CASE WHEN t <= train_end AND target_t < test_start THEN 'train' WHEN t BETWEEN test_start AND test_end THEN 'test' END AS split_c FROM sx)",
        "sw AS (SELECT * FROM sy WHERE (run, fraction) IN (SELECT (run, fraction) FROM sy GROUP BY run, fraction HAVING count(*) FILTER (split_a = 'train') >= 40 AND count(*) FILTER (split_a = 'test') >= 5 AND count(*) FILTER (split_c = 'train') >= 40 AND count(*) FILTER (split_c = 'test') >= 5))",
        sums("a", "k_aware"), sums("c", "k_naive"),
        f"it AS (SELECT q.record, fraction, sqrt(avg((x - v) * (x - v))) AS ri FROM (SELECT series_id AS record, t, v, lead(v, {h}) OVER (PARTITION BY series_id ORDER BY t) AS x FROM s) q JOIN bw USING (record) WHERE x IS NOT NULL AND t BETWEEN test_start AND test_end GROUP BY 1, 2 HAVING count(*) >= 5)",
        f"mg AS (SELECT run, record, condition, share, placement, 1 - n / whole AS missing, (whole - n) / greatest(1, segs - base) AS mean_gap FROM (SELECT run, record, condition, share, placement, count(*) AS n, count(DISTINCT seg) AS segs FROM sg GROUP BY ALL) JOIN (SELECT series_id AS record, count(*) AS whole, 1 + count(*) FILTER (b) AS base FROM (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) <> {STEP} AS b FROM s) GROUP BY 1) USING (record))",
        "ru AS (SELECT mg.*, fraction, a.n AS n_a, c.n AS n_c, a.rp AS rmse_p_a, a.rm AS rmse_m_a, c.rp AS rmse_p_c, c.rm AS rmse_m_c, 100 * (1 - a.rm / a.rp) AS skill_a, 100 * (1 - c.rm / c.rp) AS skill_c, 100 * (1 - c.rm / c.rp) - 100 * (1 - a.rm / a.rp) AS bias, a.rm - a.rp AS excess_a, c.rm - c.rp AS excess_c, (c.rm - c.rp) - (a.rm - a.rp) AS rmse_bias, ri AS rmse_p_intact, 100 * (1 - a.rm / a.rp) > -50 AND a.rp / ri BETWEEN 0.7 AND 1.4 AS reliable FROM ea a JOIN ec c USING (run, record, fraction) JOIN mg USING (run, record) LEFT JOIN it USING (record, fraction))",
    ]


_R4 = lambda names: ", ".join(f"round({n}, 4) AS {n}" for n in names.split())

QUERIES = {
    "aligned_table": (aligned_table, " UNION ALL ".join(f"SELECT * FROM ({_aligned_sql(h)})" for h in HORIZONS)),
    "pair_decomposition": (pair_decomposition, " UNION ALL ".join(f"SELECT * FROM ({_pair_sql(h)})" for h in HORIZONS)),
    "depth_arms": (depth_arms, " UNION ALL ".join(f"SELECT * FROM ({_depth_sql(w)})" for w in DEPTHS)),
    "mixture_table": (mixture_table, " UNION ALL ".join(f"SELECT * FROM ({_mixture_sql(h)})" for h in HORIZONS)),
    "clark_west_arms": (clark_west_arms, _cw_sql()),
    "channel_lead_times": (channel_lead_times, " UNION ALL ".join(f"SELECT * FROM ({_lead_sql(h)})" for h in HORIZONS)),
    "walk_forward_profile": (walk_forward_profile, with_(_WALK, f"SELECT series_id, d, n, round(rmse, 4) AS rmse, round(far_rmse, 4) AS far_rmse, n_far, round(100 * (rmse / far_rmse - 1), 4) AS inflation FROM (SELECT series_id, d, count(*) AS n, sqrt(avg(sq_m)) AS rmse FROM wx WHERE d <= 12 GROUP BY 1, 2 HAVING count(*) >= 3) JOIN (SELECT series_id, sqrt(avg(sq_m)) AS far_rmse, count(*) AS n_far FROM wx WHERE {_FAR} GROUP BY 1) USING (series_id)")),
    "walk_forward_inflation": (walk_forward_inflation, with_(_WALK, f"SELECT series_id, n_far, n_first, round(m, 4) AS model_ratio, round(p, 4) AS persistence_ratio, round(m / p, 4) AS ratio, CASE WHEN m > p THEN 'model' WHEN m < p THEN 'persistence' ELSE 'equal' END AS hurt_more FROM (SELECT series_id, count(*) FILTER ({_FAR}) AS n_far, count(*) FILTER (d = 1) AS n_first, sqrt(avg(sq_m) FILTER (d = 1)) / sqrt(avg(sq_m) FILTER ({_FAR})) AS m, sqrt(avg(sq_p) FILTER (d = 1)) / sqrt(avg(sq_p) FILTER ({_FAR})) AS p FROM wx GROUP BY 1) WHERE n_far > 20")),
    "rolling_origin_refit": (rolling_origin_refit, with_(_REFIT, "SELECT series_id, origin::INTEGER AS origin, round(a.skill, 4) AS skill_a, round(c.skill, 4) AS skill_c, round(c.skill - a.skill, 4) AS bias, a.n AS n_a, c.n AS n_c FROM (SELECT series_id, origin, count(*) AS n, 100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))) AS skill FROM qa GROUP BY 1, 2) a JOIN (SELECT series_id, origin, count(*) AS n, 100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))) AS skill FROM qc GROUP BY 1, 2) c USING (series_id, origin)", True)),
    "injection_runs": (injection_runs, with_(sweep_sql(), f"SELECT record, condition, share, placement, fraction, n_a, n_c, {_R4('rmse_p_a rmse_m_a rmse_p_c rmse_m_c skill_a skill_c bias rmse_p_intact')}, reliable FROM ru", True)),
    "injection_mixture": (injection_mixture, with_(sweep_sql(), f"SELECT record, condition, share, placement, fraction, round(f, 4) AS f, round(rho_p, 4) AS rho_p, round(rho_m, 4) AS rho_m, round(100 * rmse_m_a / rmse_p_a * (1 - sqrt((1 + f * (rho_m * rho_m - 1)) / (1 + f * (rho_p * rho_p - 1)))), 4) AS bias_hat, round(least(1.0::DOUBLE, missing * {DEPTH + H} / ((1 - missing) * mean_gap)), 4) AS f_design FROM (SELECT *, sqrt(p2) / rmse_p_a AS rho_p, sqrt(m2) / rmse_m_a AS rho_m FROM (SELECT *, (rmse_p_c * rmse_p_c - (1 - f) * rmse_p_a * rmse_p_a) / f AS p2, (rmse_m_c * rmse_m_c - (1 - f) * rmse_m_a * rmse_m_a) / f AS m2 FROM (SELECT *, 1 - n_a / n_c AS f FROM ru) WHERE f > 1e-6) WHERE p2 > 0 AND m2 > 0)", True)),
    "injection_pooled": (injection_pooled, with_(sweep_sql(), "SELECT condition, count(*) AS n, round(avg(bias), 4) AS mean, round(quantile_cont(bias, 0.5), 4) AS median, count(bias) FILTER (reliable) AS n_reliable, round(avg(bias) FILTER (reliable), 4) AS mean_reliable FROM ru GROUP BY 1", True)),
    "model_arms": (model_arms, None),
    "model_agreement": (model_agreement, None),
    "seed_spread": (seed_spread, None),
    "parameter_grid": (parameter_grid, None),
    "tuned_cell": (tuned_cell, None),
}
