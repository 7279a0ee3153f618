"""Studies over result tables: resumable sweeps, tables joined with others, calendars, fills and depths compared, variants of the context
test, paired intervals by stratum, numbers of many tables in one, and files as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import skill
from ..operators import bootstrap, grid, hac, models, origins, profile, ranks, scores, segments, summary
from ..operators.blocked import placed
from ..sources import readers
from ..sources.tables import shared_path, stored
from .base import EV, SCORES, SEQ, STEP, H, events, grid_sql, naive_rows, naive_sql, placed_rows, rounded, s_sql, scored_rows, seg_sql, series, with_
from .evaluation import DEPTHS, PAIR, PLACEMENTS, _pair_sql, arm_rows, depth_arms, injection_sweep, intact_errors, pair_arms_sql, ridge_arms, sharing_copies, sweep_sql
from .experiments import _FILL
from .inference import DRAWS, _RT, _draw_sql, _normal_sf_sql, _pct, _runs_table, _t_two_sided_sql
from .modelling import K, design

# --- a sweep that goes on where it was broken off --------------------------------------------------------------------

SWEEP_HORIZONS = (1, 3)
SWEEP_BY = ["horizon", "placement"]
SWEEP = ["record", "condition", "share", "fraction", "n_a", "n_c", "skill_a", "skill_c", "bias", "excess_a", "excess_c", "rmse_bias", "rmse_p_intact", "reliable"]


def resume_sweep(spark, d, path: str, horizons: tuple[int, ...] = SWEEP_HORIZONS, placements: tuple[int, ...] = PLACEMENTS, most: int | None = None) -> list[tuple[int, int]]:
    """The injection sweep, one part for each horizon and placement, into the result table at path. Parts that the table holds are left as they
    are; each other one is written by itself. Gives the parts that were run, at most `most`."""
    parts = spark.createDataFrame([(h, p) for h in horizons for p in placements], "horizon int, placement int")
    todo = [tuple(r) for r in readers.unfinished(parts, path, SWEEP_BY).orderBy(*SWEEP_BY).collect()][:most]  # as many as the parameters name
    with sharing_copies():  # horizons read the same copies
        for h, p in todo:
            rows = injection_sweep(spark, d, h, (p,)).select(*SWEEP, F.lit(h).alias("horizon"), "placement")
            readers.write_part(rows, path, {"horizon": h, "placement": p})
    return todo


def sweep_table(spark, d) -> DataFrame:
    """The sweep's whole table, after a run that was broken off and one that went on."""
    path = shared_path(spark, "sweep")
    with sharing_copies():
        resume_sweep(spark, d, path, most=1)
        resume_sweep(spark, d, path)
    return spark.read.parquet(path)


def resumed_sweep(spark, d):
    return rounded(sweep_table(spark, d).select("record", "condition", "share", "placement", "fraction", "horizon", "n_a", "n_c", "bias", "excess_a", "excess_c", "rmse_bias"), 4)


def bias_agreement(spark, d):
    """For each record with over 3 runs: whether the bias in skill and in RMSE go together (Pearson and Spearman), and their means."""
    s = stored(sweep_table(spark, d).select(F.col("record").alias("series_id"), "bias", "rmse_bias"), "biases")
    r = hac.pearson(s, F.col("bias"), F.col("rmse_bias")).join(hac.spearman(s, "bias", "rmse_bias", few=True).select("series_id", "rho"), K)
    m = s.groupBy(*K).agg(F.avg("bias").alias("mean_bias"), F.avg("rmse_bias").alias("mean_rmse_bias"))
    return rounded(r.where("n > 3").join(m, K), 4)


def sweep_by_model(spark, d):
    """Mean, median and number of runs by model and condition; models: ridge on value and level, and on the level alone."""
    each = injection_sweep(spark, d, models={"pair": PAIR, "level": ["kalman"]})
    return rounded(each.groupBy("model", "condition").agg(F.count("*").alias("n"), F.avg("bias").alias("mean"), F.percentile("bias", 0.5).alias("median")), 4)


def intact_references(spark, d, least: int = 50):
    """Median over origins of persistence's error on the intact record, of origins with at least 50 rows."""
    w = origins.origin_bounds(series(spark, d), [0.6, 0.7, 0.8], SEQ, H).select(F.col("series_id").alias("record"), "fraction", "train_end", "test_start", "test_end").dropna()
    return rounded(intact_errors(spark, d, stored(w, "windows"), H, least).groupBy("record").agg(F.percentile("rmse_p_intact", 0.5).alias("rmse_reference"), F.count("*").alias("n_origins")), 5)


def _sweep_rows(body: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({with_(sweep_sql(h), body.replace('HORIZON', str(h)), True)})" for h in SWEEP_HORIZONS)


_REFERENCE = [
    EV, s_sql(), "bn AS (SELECT series_id AS record, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM s)",
    f"bf AS (SELECT *, least(n - 1, i_start + floor(0.25 * n)::BIGINT) AS i_end FROM (SELECT *, i_train + {SEQ + H} AS i_start FROM (SELECT record, n, fraction, floor(fraction * n)::BIGINT AS i_train FROM (SELECT record, max(n) AS n, unnest([0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE]) AS fraction FROM bn GROUP BY 1))))",
    "bw AS (SELECT f.record, fraction, b.t AS test_start, c.t AS test_end FROM bf f JOIN bn b ON b.record = f.record AND b.r = i_start JOIN bn c ON c.record = f.record AND c.r = i_end)",
    f"it AS (SELECT q.record, fraction, sqrt(avg((x - v) * (x - v))) AS ri FROM (SELECT series_id AS record, t, v, lead(v, {H}) OVER (PARTITION BY series_id ORDER BY t) AS x FROM s) q JOIN bw USING (record) WHERE x IS NOT NULL AND t BETWEEN test_start AND test_end GROUP BY 1, 2 HAVING count(*) >= 50)",
]


# --- tables beside others ---------------------------------------------------------------------------------------------


def depth_against_main(spark, d):
    """The depth sweep beside the main table's arms (each made by itself): how the bias at each depth differs from the main one."""
    main = scores.arm_skills(ridge_arms(arm_rows(spark, d, H, PAIR), len(PAIR), [*K, "arm"]))
    sweep = depth_arms(spark, d).select(*K, "w", F.col("total").alias("total_sweep"), F.col("n_a").alias("n_a_sweep"))
    both = sweep.join(main.select(*K, F.round("total", 4).alias("total_main"), F.col("n_a").alias("n_a_main")), K)
    return rounded(both.withColumn("change", F.col("total_sweep") - F.col("total_main")), 4)


def _depth_main_sql() -> str:
    sweep = " UNION ALL ".join(f"SELECT * FROM ({_pair_sql(H, w).replace(f'{H} AS horizon', f'{w} AS w', 1)})" for w in DEPTHS)
    return f"SELECT series_id, w, s.total AS total_sweep, s.n_a AS n_a_sweep, m.total AS total_main, m.n_a AS n_a_main, round(s.total - m.total, 4) AS change FROM ({sweep}) s JOIN ({_pair_sql(H)}) m USING (series_id)"


def common_profile(spark, d):
    """Distance profiles of two horizons on the series and distances that both have."""
    one, three = (profile.distance_profile(scored_rows(spark, d, h), 8, h, least=3).select(*K, "d", "n", "inflation") for h in (1, 3))
    one, three = stored(one, "profile"), stored(three, "profile")
    common = summary.common_keys(one, three, [*K, "d"])
    a, b = (x.withColumnsRenamed({"n": f"n_{h}", "inflation": f"inflation_{h}"}) for x, h in ((one, 1), (three, 3)))
    return rounded(common.join(a, [*K, "d"]).join(b, [*K, "d"]), 4)


def _profile_sql(h: int) -> str:
    scored = [c.replace(naive_sql(), naive_sql(h)) for c in SCORES]
    far = f"(d > 8 AND NOT displaced AND to_gap > {h})"
    return with_(scored, f"SELECT series_id, d, n AS n_{h}, round(100 * (rmse / far_rmse - 1), 4) AS inflation_{h} FROM (SELECT series_id, d, count(*) AS n, sqrt(avg(sq)) AS rmse FROM sc WHERE d <= 12 GROUP BY 1, 2 HAVING count(*) >= 3) JOIN (SELECT series_id, sqrt(avg(sq)) AS far_rmse FROM sc WHERE {far} GROUP BY 1) USING (series_id)")


def complete_cell_runs(spark, d):
    """Mean bias by condition over the runs of complete cells: those for which every condition has at least three runs."""
    runs = stored(_runs_table(spark, d), "runs")
    cells = summary.complete_cells(summary.cell_means(runs, "bias", ["series_id", "share"], least=3)).select("series_id", "share")
    kept = runs.join(cells, ["series_id", "share"], "left_semi")
    return rounded(kept.groupBy("condition").agg(F.count("*").alias("n"), F.avg("bias").alias("mean")), 5)


def collated_numbers(spark, d):
    """Numbers of several result tables in long form, read back from where they were written. A table that isn't there is one row that says so."""
    place = shared_path(spark, "tables")
    runs = stored(_runs_table(spark, d), "runs")
    by = runs.groupBy("condition").agg(F.count("*").alias("n"), F.avg("bias").alias("mean"), F.percentile("bias", 0.5).alias("median"))
    readers.write_results(rounded(by, 5), f"{place}/bias", csv=True)
    readers.write_results(rounded(summary.reliable_share(runs, "bias", 2.0), 5), f"{place}/large", csv=True)
    wanted = {"bias": ["n", "mean", "median"], "large": ["n", "share"], "never_run": ["n"]}
    return rounded(summary.collate({name: readers.read_results(spark, f"{place}/{name}") for name in wanted}, "condition", wanted, spark), 5)


# --- calendars, fills, depths -------------------------------------------------------------------------------------------


def calendar_audit(spark, d):
    """The bias on C's own calendar (the first three quarters of its rows train, the rest test, no embargo) against that on A's calendar:
    what the unaligned window adds. Ridge on value and level."""
    rows = design(placed_rows(spark, d))
    long = stored(scores.arm_rows(rows, ["a_lag_0", "a_kalman"], ["n_lag_0", "n_kalman"]), "arm-rows")
    own = origins.numbered(rows).withColumn("role", F.when(F.col("_r") < F.floor(F.col("_c") * 0.75), "train").otherwise("test"))
    published = stored(own.select(*K, "t", "v", "target", "valid", F.lit("p").alias("arm"), "role", F.col("n_lag_0").alias("x0"), F.col("n_kalman").alias("x1")), "published")
    predicted = ridge_arms(published, 2, [*K, "arm"])
    em, ep = F.col("target") - F.col("prediction"), F.col("target") - F.col("v")
    p = predicted.groupBy(*K).agg(skill(F.sum(em * em), F.sum(ep * ep)).alias("skill_c_published"), F.count("*").alias("n_test_c_published"), F.min("t").alias("_c0"))
    sizes = published.groupBy(*K).agg(F.count("*").alias("n_naive"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"))
    a0 = long.where("arm = 'a' and role = 'test'").groupBy(*K).agg(F.min("t").alias("_a0"))
    got = scores.arm_skills(ridge_arms(long, 2, [*K, "arm"])).join(p, K).join(sizes, K).join(a0, K)
    old, new = F.col("skill_c_published") - F.col("skill_a"), F.col("skill_c") - F.col("skill_a")
    return rounded(got.select(*K, "n_valid", "n_naive", (100 * F.col("n_valid") / F.col("n_naive")).alias("pct_valid"), ((F.col("_a0") - F.col("_c0")) / 86400).alias("drift_days"), "skill_a", "skill_b", "skill_c_published", F.col("skill_c").alias("skill_c_aligned"), old.alias("bias_published"), new.alias("bias_aligned"), (old - new).alias("window_artifact"), "n_test_c_published"), 4)


_AUDIT = [
    "pr AS (SELECT q.*, CASE WHEN r < floor(c * 0.75) THEN 'train' ELSE 'test' END AS split FROM (SELECT nv.*, kn.x AS k_naive, row_number() OVER (PARTITION BY nv.series_id ORDER BY nv.t) - 1 AS r, count(*) OVER (PARTITION BY nv.series_id) AS c FROM nv JOIN kn USING (series_id, t) WHERE nv.target IS NOT NULL) q)",
    "pf AS (SELECT q.*, my + b1 * (v - m1) + b2 * (k_naive - m2) AS p FROM pr q JOIN (FIT) USING (series_id) WHERE split = 'test')",
]


def _audit_sql() -> str:
    from .evaluation import _fit2

    fit = _fit2("v", "k_naive", "(SELECT * FROM pr WHERE split = 'train')")
    sk = lambda a: f"SELECT series_id, count(*) AS n, min(t) AS t0, 100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))) AS skill FROM {a} GROUP BY 1"
    return with_([*pair_arms_sql(H), *[c.replace("FIT", fit) for c in _AUDIT]], f"""SELECT series_id, n_valid, n_naive, round(100 * n_valid / n_naive, 4) AS pct_valid, round((a.t0 - p.t0) / 86400, 4) AS drift_days, round(a.skill, 4) AS skill_a, round(b.skill, 4) AS skill_b, round(p.skill, 4) AS skill_c_published, round(c.skill, 4) AS skill_c_aligned,
      round(p.skill - a.skill, 4) AS bias_published, round(c.skill - a.skill, 4) AS bias_aligned, round(p.skill - c.skill, 4) AS window_artifact, p.n AS n_test_c_published
    FROM ({sk('pa')}) a JOIN ({sk('pb')}) b USING (series_id) JOIN ({sk('pc')}) c USING (series_id) JOIN ({sk('pf')}) p USING (series_id) JOIN (SELECT series_id, count(*) AS n_naive FROM pr GROUP BY 1) USING (series_id) JOIN (SELECT series_id, count(*) AS n_valid FROM va GROUP BY 1) USING (series_id)""", True)


FILL_LIMIT = 3


def fill_bias(spark, d):
    """The bias with and without short gaps filled: each series as it is and filled, through features, splits and arms, and the change."""
    raw = series(spark, d)
    filled = grid.fill_short_gaps(grid.reindex(raw, STEP), FILL_LIMIT).where("v is not null").select("series_id", "t", "v")
    out = []
    for name, s in (("raw", raw), ("filled", filled)):
        p = stored(placed(s, STEP), "placed")
        long = stored(scores.arm_rows(design(p), ["a_lag_0", "a_kalman"], ["n_lag_0", "n_kalman"]), "arm-rows")
        got = scores.arm_skills(ridge_arms(long, 2, [*K, "arm"])).select(*K, F.col("skill_a").alias(f"skill_a_{name}"), F.col("skill_c").alias(f"skill_c_{name}"), F.col("total").alias(f"bias_{name}"))
        out.append(got.join(p.groupBy(*K).agg(F.count("*").alias(f"n_{name}"), F.countDistinct("seg").alias(f"segments_{name}")), K))
    return rounded(out[0].join(out[1], K).withColumn("change", F.col("bias_raw") - F.col("bias_filled")), 4)


def _fill_bias_sql() -> str:
    def one(name: str, ctes: list[str]) -> str:
        arms = [*ctes, seg_sql(), *pair_arms_sql(H)[3:]]
        sk = lambda a: f"SELECT series_id, 100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))) AS skill FROM {a} GROUP BY 1"
        return with_(arms, f"SELECT series_id, a.skill AS skill_a_{name}, c.skill AS skill_c_{name}, c.skill - a.skill AS bias_{name}, n_{name}, segments_{name} FROM ({sk('pa')}) a JOIN ({sk('pc')}) c USING (series_id) JOIN (SELECT series_id, count(*) AS n_{name}, count(DISTINCT seg) AS segments_{name} FROM seg GROUP BY 1) USING (series_id)", True)

    raw, filled = one("raw", [EV, s_sql()]), one("filled", [EV, s_sql(name="s0"), grid_sql(STEP, "s0"), _FILL, "s AS (SELECT * FROM fl WHERE v IS NOT NULL)"])
    columns = ", ".join(f"round({x}_{n}, 4) AS {x}_{n}" for n in ("raw", "filled") for x in ("skill_a", "skill_c", "bias"))
    return f"SELECT series_id, {columns}, n_raw, segments_raw, n_filled, segments_filled, round(bias_raw - bias_filled, 4) AS change FROM ({raw}) JOIN ({filled}) USING (series_id)"


def channel_depths(spark, d):
    """The channels of the bias by feature depth, pooled over series by mean absolute value and by signed sum, with the embargo of the main table."""
    parts = depth_arms(spark, d)
    return rounded(scores.channel_shares(parts, ["w"]).select("w", "method", "feature", "training", "composition", "total", "share_feature", "share_training", "share_composition"), 3)


def _channel_depths_sql() -> str:
    sweep = " UNION ALL ".join(f"SELECT * FROM ({_pair_sql(H, w).replace(f'{H} AS horizon', f'{w} AS w', 1)})" for w in DEPTHS)
    names = ("feature", "training", "composition", "total")
    each = " UNION ALL ".join(f"SELECT w, '{m}' AS method, {', '.join(f'{f.format(n)} AS {n}' for n in names)} FROM sweep GROUP BY w" for m, f in (("mean_abs", "avg(abs({}))"), ("signed_sum", "sum({})")))
    whole = "(abs(feature) + abs(training) + abs(composition))"
    shares = ", ".join(f"round(100 * abs({n}) / nullif({whole}, 0), 3) AS share_{n}" for n in names[:3])
    return f"WITH sweep AS ({sweep}), ch AS ({each}) SELECT w, method, {', '.join(f'round({n}, 3) AS {n}' for n in names)}, {shares} FROM ch"


# --- context before gaps -----------------------------------------------------------------------------------------------

CONTEXT = 6


def context_variants(spark, d, least: tuple[int, int] = (10, 30)):
    """Deviation and largest of the one-step changes before gaps against baseline windows, by both ways of choosing windows: medians, their ratio, and
    rank tests of the deviation. Series with fewer than 10 gaps or 30 baseline windows that can be used are left out."""
    w = stored(profile.context_windows(grid.reindex(series(spark, d), STEP), CONTEXT, STEP), "context")
    keys = [*K, "method"]
    n = w.groupBy(*keys).agg(F.count(F.when(F.col("before_gap"), 1)).alias("n_gaps"), F.count(F.when(~F.col("before_gap"), 1)).alias("n_baseline"))
    n = n.where((F.col("n_gaps") >= least[0]) & (F.col("n_baseline") >= least[1]))
    m = [ranks.percentiles(w, c, {c: 0.5}, [*keys, "before_gap"]) for c in ("sd", "ramp")]
    at = lambda c, before: F.max(F.when(F.col("before_gap") == before, F.col(c)))
    wide = [x.groupBy(*keys).agg(at(c, True).alias(f"pre_gap_{c}"), at(c, False).alias(f"baseline_{c}")) for x, c in zip(m, ("sd", "ramp"), strict=True)]
    z = hac.mann_whitney(w, F.col("before_gap"), "sd", keys)
    one = hac.p_values(z, "z", "greater").select(*keys, F.col("p").alias("p_greater"))
    out = n.join(wide[0], keys).join(wide[1], keys).join(one, keys)
    return rounded(out.withColumn("ratio", F.col("pre_gap_sd") / F.col("baseline_sd")), 5)


def _context_sql() -> str:
    w, half = CONTEXT, max(1, CONTEXT // 2)
    diffs = "list_transform(range(2, len(a) + 1), lambda k: a[k] - a[k - 1])"
    ctes = [
        EV, s_sql(), grid_sql(),
        f"cw AS (SELECT *, list(v) FILTER (v IS NOT NULL) OVER f AS a, row_number() OVER o AS j, lead(t) OVER o IS NOT NULL AND lead(v) OVER o IS NULL AND v IS NOT NULL AS ends FROM g WINDOW o AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))",
        "cl AS (SELECT *, max(j) OVER (PARTITION BY series_id) AS last FROM cw)",
        f"""ck AS (SELECT series_id, 'clean' AS method, true AS before_gap, a FROM cl WHERE ends AND len(a) = {w}
          UNION ALL SELECT series_id, 'legacy', true, a FROM cl WHERE ends AND len(a) >= {max(5, w // 2)}
          UNION ALL SELECT series_id, 'clean', false, a FROM cl q WHERE j % {w} = 0 AND j < last AND len(a) = {w} AND NOT EXISTS (FROM cl e WHERE e.series_id = q.series_id AND e.ends AND abs(e.j - q.j) <= {w})
          UNION ALL SELECT series_id, 'legacy', false, a FROM cl WHERE (j - {w}) % {half} = 0 AND j >= {w} AND j < last AND len(a) = {w})""",
        f"cs AS (SELECT series_id, method, before_gap, list_stddev_pop(b) AS sd, list_max(list_transform(b, lambda x: abs(x))) AS ramp FROM (SELECT *, {diffs} AS b FROM ck))",
        "cn AS (SELECT series_id, method, count(*) FILTER (before_gap) AS n_gaps, count(*) FILTER (NOT before_gap) AS n_baseline, quantile_cont(sd, 0.5) FILTER (before_gap) AS pre_gap_sd, quantile_cont(sd, 0.5) FILTER (NOT before_gap) AS baseline_sd, quantile_cont(ramp, 0.5) FILTER (before_gap) AS pre_gap_ramp, quantile_cont(ramp, 0.5) FILTER (NOT before_gap) AS baseline_ramp FROM cs GROUP BY 1, 2 HAVING n_gaps >= 10 AND n_baseline >= 30)",
        "cr AS (SELECT series_id, method, count(*) AS n, count(*) FILTER (before_gap) AS n1, sum(r) FILTER (before_gap) AS s, sum(k * k - 1)::DOUBLE AS ties FROM (SELECT *, rank() OVER (PARTITION BY series_id, method ORDER BY sd) + (count(*) OVER (PARTITION BY series_id, method, sd) - 1) / 2 AS r, count(*) OVER (PARTITION BY series_id, method, sd) AS k FROM cs) GROUP BY 1, 2)",
        "cz AS (SELECT series_id, method, CASE WHEN sp > 0 THEN (s - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 - 0.5) / sp END AS z FROM (SELECT *, sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sp FROM cr))",
    ]
    rounds = ", ".join(f"round({c}, 5) AS {c}" for c in ("pre_gap_sd", "baseline_sd", "pre_gap_ramp", "baseline_ramp"))
    return with_(ctes, f"SELECT series_id, method, n_gaps, n_baseline, {rounds}, round({_normal_sf_sql('z')}, 5) AS p_greater, round(pre_gap_sd / baseline_sd, 5) AS ratio FROM cn JOIN cz USING (series_id, method)")


# --- intervals by stratum ----------------------------------------------------------------------------------------------


def stratified_paired(spark, d):
    """Mean bias of each condition, and of MANY-SHORT less FEW-LONG, with intervals under the same draws: weeks are drawn within each series, one
    table of weights for all statistics."""
    runs = _runs_table(spark, d).select(*K, "condition", "bias", F.concat_ws("/", "series_id", F.col("week").cast("string")).alias("cluster"))
    runs = stored(runs.withColumn("all", F.lit(0)), "runs")
    w = stored(bootstrap.cluster_weights(runs, DRAWS.get()[0], 7, K), "weights")
    each = bootstrap.cluster_mean_interval(runs, "bias", w, ["condition"])
    means = runs.groupBy("condition").agg(F.avg("bias").alias("mean")).join(each, "condition")
    both = bootstrap.paired_difference_interval(runs, "bias", "condition", "MANY-SHORT", "FEW-LONG", w, ["all"])
    of = lambda c: F.avg(F.when(F.col("condition") == c, F.col("bias")))
    paired = runs.groupBy("all").agg((of("MANY-SHORT") - of("FEW-LONG")).alias("mean")).join(both, "all").select(F.lit("MANY-SHORT - FEW-LONG").alias("condition"), "mean", "ci_lo", "ci_hi", "n_reps")
    return rounded(means.select(*paired.columns).unionByName(paired), 4)


_STRATA = [
    *_RT, "cl AS (SELECT *, series_id || '/' || week AS cluster FROM rt)",
    "cn AS (SELECT series_id, cluster, row_number() OVER (PARTITION BY series_id ORDER BY cluster) - 1 AS place FROM (SELECT DISTINCT series_id, cluster FROM cl))",
    "cw AS (SELECT cluster, rep, count(*) AS weight FROM (" + _draw_sql("(SELECT series_id, count(*) AS n FROM cn GROUP BY 1)", "n", "n") + ") JOIN cn USING (series_id, place) GROUP BY 1, 2)",
    "cm AS (SELECT condition, cluster, sum(bias) AS s, count(*) AS c FROM cl GROUP BY 1, 2)",
    "ra AS (SELECT condition AS series_id, rep, sum(s * weight) / sum(c * weight) AS mean FROM cm JOIN cw USING (cluster) GROUP BY 1, 2)",
    "rb AS (SELECT 'MANY-SHORT - FEW-LONG' AS series_id, rep, max(mean) FILTER (series_id = 'MANY-SHORT') - max(mean) FILTER (series_id = 'FEW-LONG') AS mean FROM ra GROUP BY rep)",
    "me AS (SELECT condition AS series_id, avg(bias) AS mean FROM cl GROUP BY 1 UNION ALL SELECT 'MANY-SHORT - FEW-LONG', avg(bias) FILTER (condition = 'MANY-SHORT') - avg(bias) FILTER (condition = 'FEW-LONG') FROM cl)",
]


# --- models with tests ---------------------------------------------------------------------------------------------------


def model_tests(spark, d):
    """Persistence, last-5 mean and one-feature ridge on the same test rows: errors, skill, and p of the Diebold-Mariano test against persistence."""
    split = origins.published_split(naive_rows(spark, d).where("target is not null and m5 is not null"))
    ridge = scores.predict_ridge1(split.where("split = 'test'"), scores.fit_ridge1(split.where("split = 'train'"), "m5"), "m5")
    each = ridge.select("series_id", "t", "v", "target", F.explode(F.map_from_arrays(F.array(F.lit("persistence"), F.lit("mean5"), F.lit("ridge1")), F.array("v", "m5", "prediction"))).alias("model", "p"))
    each = stored(each, "model-rows")
    e, b = F.col("target") - F.col("p"), F.col("target") - F.col("v")
    table = each.groupBy("series_id", "model").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), skill(F.sum(e * e), F.sum(b * b)).alias("skill"))
    dm = hac.p_values(hac.diebold_mariano(each.where("model <> 'persistence'"), e, b, H, [*K, "model"]), "dm").select(*K, "model", "p")
    return rounded(table.join(dm, [*K, "model"], "left"), 5)


def _model_tests_sql() -> str:
    from .experiments import _SPLIT_FIT
    from .evaluation import _dm_sql

    ctes = [
        *SCORES, "ps AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 < floor(0.75 * count(*) OVER (PARTITION BY series_id)) THEN 'train' ELSE 'test' END AS split FROM sc)",
        f"pr AS (SELECT ps.*, my + b * (m5 - mx) AS r FROM ps JOIN ({_SPLIT_FIT}) USING (series_id) WHERE split = 'test')",
        "ea AS (SELECT series_id, target, v, 'persistence' AS model, v AS p FROM pr UNION ALL SELECT series_id, target, v, 'mean5', m5 FROM pr UNION ALL SELECT series_id, target, v, 'ridge1', r FROM pr)",
        "pm AS (SELECT series_id, t, target, v, m5 AS p FROM pr)", *_dm_sql(H, "m"), "pq AS (SELECT series_id, t, target, v, r AS p FROM pr)", *_dm_sql(H, "q"),
        "dp AS (SELECT series_id, 'mean5' AS model, p FROM dmm UNION ALL SELECT series_id, 'ridge1', p FROM dmq)",
    ]
    return with_(ctes, "SELECT ea.*, round(dp.p, 5) AS p FROM (SELECT series_id, model, count(*) AS n, round(sqrt(avg((target - p) * (target - p))), 5) AS rmse, round(avg(abs(target - p)), 5) AS mae, round(100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))), 5) + 0.0::DOUBLE AS skill FROM ea GROUP BY 1, 2) ea LEFT JOIN dp USING (series_id, model)")


QUERIES = {
    "resumed_sweep": (resumed_sweep, _sweep_rows("SELECT record, condition, share, placement, fraction, HORIZON AS horizon, n_a, n_c, round(bias, 4) AS bias, round(excess_a, 4) AS excess_a, round(excess_c, 4) AS excess_c, round(rmse_bias, 4) AS rmse_bias FROM ru")),
    "bias_agreement": (bias_agreement, "WITH rr AS (" + _sweep_rows("SELECT record AS series_id, bias, rmse_bias FROM ru") + "), rk AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY bias) + (count(*) OVER (PARTITION BY series_id, bias) - 1) / 2 AS ra, rank() OVER (PARTITION BY series_id ORDER BY rmse_bias) + (count(*) OVER (PARTITION BY series_id, rmse_bias) - 1) / 2 AS rb FROM rr) SELECT series_id, count(*) AS n, round(corr(bias, rmse_bias), 4) AS r, round(corr(ra, rb), 4) AS rho, round(avg(bias), 4) AS mean_bias, round(avg(rmse_bias), 4) AS mean_rmse_bias FROM rk GROUP BY 1 HAVING count(*) > 3"),
    "sweep_by_model": (sweep_by_model, " UNION ALL ".join(f"SELECT * FROM ({with_(sweep_sql(H, pair), f'SELECT {chr(39)}{m}{chr(39)} AS model, condition, count(*) AS n, round(avg(bias), 4) AS mean, round(quantile_cont(bias, 0.5), 4) AS median FROM ru GROUP BY 2', True)})" for m, pair in (("pair", True), ("level", False)))),
    "intact_references": (intact_references, with_(_REFERENCE, "SELECT record, round(quantile_cont(ri, 0.5), 5) AS rmse_reference, count(*) AS n_origins FROM it GROUP BY 1")),
    "depth_against_main": (depth_against_main, _depth_main_sql()),
    "common_profile": (common_profile, f"SELECT * FROM ({_profile_sql(1)}) JOIN ({_profile_sql(3)}) USING (series_id, d)"),
    "complete_cell_runs": (complete_cell_runs, with_(_RT, "SELECT condition, count(*) AS n, round(avg(bias), 5) AS mean FROM rt WHERE (series_id, share) IN (SELECT (series_id, share) FROM (SELECT series_id, share, condition FROM rt GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY series_id, share HAVING count(*) = 3) GROUP BY 1")),
    "collated_numbers": (collated_numbers, with_([*_RT, "lg AS (SELECT condition, count(*) FILTER (abs(bias) <= 2) AS n, count(*) FILTER (abs(bias) <= 2) / count(*) AS share FROM rt GROUP BY 1)"], "SELECT 'bias' AS \"table\", condition, unnest(['n', 'mean', 'median']) AS stat, unnest([n::DOUBLE, mean, median]) AS value FROM (SELECT condition, count(*) AS n, round(avg(bias), 5) AS mean, round(quantile_cont(bias, 0.5), 5) AS median FROM rt GROUP BY 1) UNION ALL SELECT 'large', condition, unnest(['n', 'share']), unnest([n::DOUBLE, round(share, 5)]) FROM lg UNION ALL SELECT 'never_run', NULL, 'missing', NULL")),
    "calendar_audit": (calendar_audit, _audit_sql()),
    "fill_bias": (fill_bias, _fill_bias_sql()),
    "channel_depths": (channel_depths, _channel_depths_sql()),
    "context_variants": (context_variants, _context_sql()),
    "stratified_paired": (stratified_paired, with_(_STRATA, "SELECT series_id AS condition, round(mean, 4) AS mean, ci_lo, ci_hi, n_reps FROM (" + _pct("mean", "(FROM ra UNION ALL FROM rb)") + ") JOIN me USING (series_id)")),
    "model_tests": (model_tests, _model_tests_sql()),
}
