"""Queries on tests, bootstrap intervals, injected gaps, result tables and models."""

from __future__ import annotations

import re
from contextvars import ContextVar

from pyspark.sql import functions as F

from ..operators import bootstrap, features, hac, inject, models, origins, profile, scores, segments, summary, trees
from ..sources.tables import stored
from .base import DIST, LEN, SCORES, SEGS, SEQ, STEP, H, rounded, scored_rows, segmented, series, split_sql, valid_rows, valid_sql, with_
from .modelling import _CTX, _CTX_ROWS, LEAST, OWN, K

REPS = 100
#: Replicates, and times as many draws as may be made for unusable ones; (REPS, 1) in queries as first registered.
DRAWS = ContextVar("DRAWS", default=(REPS, 1))


def _errors():
    return F.col("target") - F.col("m5"), F.col("target") - F.col("v")


def _hac(spark, d):
    return scored_rows(spark, d).select("series_id", "t", "v", "m5", "target", "d", "displaced", "sq_m", "sq_p")


def dm_statistic(spark, d):
    return rounded(hac.diebold_mariano(_hac(spark, d), *_errors(), H).select("series_id", "n", "dm"), 4)


def dm_p_value(spark, d):
    return rounded(hac.p_values(hac.diebold_mariano(_hac(spark, d), *_errors(), H), "dm").select("series_id", "n", "dm", "p"))


def cw_statistic(spark, d):
    return rounded(hac.clark_west(_hac(spark, d), F.col("target"), F.col("v"), F.col("m5"), H).select("series_id", "n", "cw"), 4)


def _hac_sql(value: str, top: int = 40) -> list[str]:
    lags = ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, top + 1))
    terms = " + ".join(f"sum(CASE WHEN l >= {k} THEN 2 * (1 - {k} / (l + 1)) * c * c{k} ELSE 0 END)" for k in range(1, top + 1))
    return [
        f"hx AS (SELECT *, x - avg(x) OVER (PARTITION BY series_id) AS c, count(x) OVER (PARTITION BY series_id) AS n FROM (SELECT series_id, t, {value} AS x FROM sc))",
        f"hl AS (SELECT *, least(n - 1, greatest(10, {H - 1}, floor(4 * pow(n / 100, 2.0 / 9))::BIGINT)) AS l, {lags} FROM hx WINDOW w AS (PARTITION BY series_id ORDER BY t))",
        f"hs AS (SELECT series_id, count(x) AS n, avg(x) AS mean, greatest(1e-12, (sum(c * c) + {terms}) / count(x) / count(x)) AS variance FROM hl GROUP BY 1)",
    ]


def mann_whitney_u(spark, d):
    s = scored_rows(spark, d).where("d <= 3 or d > 8")
    return rounded(hac.mann_whitney(s, F.col("d") <= 3, "sq_p"), 4)


def mann_whitney_p(spark, d):
    """One-sided (greater) and two-sided p of early errors against late ones."""
    rows = stored(scored_rows(spark, d).where("d <= 3 or d > 8"), "early-and-late")
    one = hac.p_values(hac.mann_whitney(rows, F.col("d") <= 3, "sq_p"), "z", "greater").select("series_id", "n", "u", F.col("p").alias("p_greater"))
    two = hac.p_values(hac.mann_whitney(rows, F.col("d") <= 3, "sq_p", two_sided=True), "z", "two-sided").select("series_id", F.col("p").alias("p_two_sided"))
    return rounded(one.join(two, "series_id"))


def holm(spark, d):
    """Which series' early errors are larger after Holm's correction of the one-sided p-values."""
    s = hac.mann_whitney(scored_rows(spark, d).where("d <= 3 or d > 8"), F.col("d") <= 3, "sq_p")
    s = hac.p_values(s, "z", "greater").withColumn("family", F.lit(1))
    return rounded(hac.holm(s, "p", "series_id", 0.05, ["family"]).select("series_id", "p", "supported"), 5)


def cw_p_value(spark, d):
    """Clark-West with its one-sided p."""
    return rounded(hac.p_values(hac.clark_west(_hac(spark, d), F.col("target"), F.col("v"), F.col("m5"), H), "cw").select("series_id", "n", "p"))


def pearson_p(spark, d):
    """Correlation of the errors of model and persistence, with its p."""
    r = hac.pearson(scored_rows(spark, d), F.col("sq_m"), F.col("d"))
    return rounded(hac.p_values(r, "r", "correlation"))


def gap_context_tests(spark, d):
    """Whether deviation and ramp before gaps exceed those of baseline windows: one-sided p, Holm over all series and both measures.

    An hour's events are added in order of their ids: ramps are ranked, and two that are equal as decimals are a tie or not by a mean's last bit."""
    c = profile.pre_gap_context(segments.gap_distance(series(spark, d, order="event_id"), STEP), 6, STEP)
    long = c.select("series_id", "kind", F.explode(F.create_map(F.lit("sd"), "sd", F.lit("ramp"), "ramp")).alias("measure", "x"))
    keys = ["series_id", "measure"]
    z = hac.mann_whitney(long, F.col("kind") == "before gap", "x", keys).where("n1 >= 5 and n2 >= 5")
    p = hac.p_values(z, "z", "greater").withColumn("family", F.lit(1)).withColumn("name", F.concat_ws("/", "series_id", "measure"))
    return rounded(hac.holm(p, "p", "name", 0.05, ["family"]).select("series_id", "measure", "n1", "n2", "u", "p", "supported"), 5)


def spearman(spark, d):
    return rounded(hac.spearman(scored_rows(spark, d), "d", "sq_p"), 5)


def correlations(spark, d):
    s = scored_rows(spark, d)
    a = hac.pearson(s, F.col("sq_m"), F.col("sq_p")).withColumnRenamed("r", "pearson")
    return rounded(a.join(hac.log_correlation(s, "sq_m", "sq_p").select("series_id", F.col("r").alias("log_log")), "series_id"), 5)


def _blocks(spark, d):
    s = scored_rows(spark, d)
    return bootstrap.segment_blocks(s, 25)


def segment_blocks(spark, d):
    return _blocks(spark, d).select("series_id", "t", "block")


def bias_block_bootstrap(spark, d):
    return rounded(bias_interval(scored_rows(spark, d), 25), 4)


def bias_interval(rows, size: int):
    """Interval of the bias of scored rows for one block size: arm A has the rows that no gap touches, arm C all."""
    table = bootstrap.block_sums(bootstrap.segment_blocks(rows, size), (F.col("d") > 5) & ~F.col("displaced"), F.lit(True), "sq_m", "sq_p")
    return bootstrap.bias_of_blocks(table, DRAWS.get()[0], 7, redraws=DRAWS.get()[1])


def circular_bootstrap(spark, d):
    return rounded(bootstrap.circular_rmse_interval(scored_rows(spark, d), F.col("sq_p"), 24, DRAWS.get()[0], 7), 4)


def iid_bootstrap(spark, d):
    return rounded(bootstrap.iid_mean_interval(scored_rows(spark, d).where("displaced"), "sq_p", DRAWS.get()[0], 7, K), 4)


def _clusters(spark, d):
    s = scored_rows(spark, d)
    day = F.floor(F.col("t") / 86400)
    return s.withColumn("cluster", day.cast("bigint")).withColumn("level", F.when(F.col("displaced"), "displaced").otherwise("kept"))


def cluster_bootstrap(spark, d):
    c = _clusters(spark, d).withColumn("all", F.lit(0))
    w = bootstrap.cluster_weights(c, DRAWS.get()[0], 7, ["all"])
    return rounded(bootstrap.cluster_mean_interval(c, "sq_p", w, K, few=True), 4)


def paired_difference(spark, d):
    c = _clusters(spark, d).withColumn("all", F.lit(0))
    w = bootstrap.cluster_weights(c, DRAWS.get()[0], 7, ["all"])
    return rounded(bootstrap.paired_difference_interval(c, "sq_p", "level", "displaced", "kept", w, K, few=True), 4)


def _draw_sql(groups: str, n: str, slots: str, keys: str = "series_id", seed: int = 7) -> str:
    return f"SELECT *, ('0x' || substr(md5('{seed}|' || rep || '|' || slot), 1, 8))::UBIGINT::BIGINT % {n} AS place FROM (SELECT *, unnest(range(0, {slots})) AS slot FROM (SELECT *, unnest(range(0, {REPS})) AS rep FROM {groups}))"


def _pct(stat: str, source: str, places: int = 4) -> str:
    return f"SELECT series_id, round(quantile_cont({stat}, 0.025), {places}) AS ci_lo, round(quantile_cont({stat}, 0.975), {places}) AS ci_hi, count({stat}) AS n_reps FROM {source} GROUP BY 1"


_BLOCKS = "bk AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY seg, p) - 1 AS block FROM (SELECT *, (row_number() OVER (PARTITION BY series_id, seg ORDER BY t) - 1) // 25 AS p FROM sc))"
_BIAS = [
    _BLOCKS,
    "tb AS (SELECT series_id, block AS place, count(*) AS n_c, sum(sq_m) AS m_c, sum(sq_p) AS p_c, count(*) FILTER (ok) AS n_a, coalesce(sum(sq_m) FILTER (ok), 0) AS m_a, coalesce(sum(sq_p) FILTER (ok), 0) AS p_a FROM (SELECT *, d > 5 AND NOT displaced AS ok FROM bk) GROUP BY 1, 2)",
    "tt AS (SELECT series_id, count(*) AS n, sum(n_a) AS t_a, sum(n_c) AS t_c FROM tb GROUP BY 1)",
    "rp AS (SELECT series_id, rep, 100 * (1 - sqrt(sum(m_c) / sum(p_c))) - 100 * (1 - sqrt(sum(m_a) / sum(p_a))) AS bias FROM (" + _draw_sql("tt", "n", "n") + ") JOIN tb USING (series_id, place) GROUP BY 1, 2 HAVING sum(n_a) >= 0.5 * max(t_a) AND sum(n_c) >= 0.5 * max(t_c))",
]
_CIRC = [
    "ci AS (SELECT series_id, row_number() OVER w - 1 AS i, sum(sq_p) OVER w - sq_p AS c, count(*) OVER (PARTITION BY series_id) AS n, sum(sq_p) OVER (PARTITION BY series_id) AS whole FROM sc WINDOW w AS (PARTITION BY series_id ORDER BY t))",
    "ct AS (SELECT series_id, n, whole, b, ceil(n / b)::BIGINT AS k FROM (SELECT series_id, max(n) AS n, max(whole) AS whole, CASE WHEN max(n) < 48 THEN greatest(5, max(n) // 4) ELSE 24 END AS b FROM ci GROUP BY 1))",
    "cd AS (SELECT *, place + CASE WHEN slot = k - 1 THEN n - (k - 1) * b ELSE b END AS e FROM (" + _draw_sql("ct", "n", "k") + "))",
    "cr AS (SELECT cd.series_id, rep, sqrt(sum(z.c - y.c + CASE WHEN e >= cd.n THEN cd.whole ELSE 0 END) / max(cd.n)) AS rmse FROM cd JOIN ci y ON y.series_id = cd.series_id AND y.i = place JOIN ci z ON z.series_id = cd.series_id AND z.i = e % cd.n GROUP BY 1, 2)",
]
_CLUST = [
    "cl AS (SELECT *, t // 86400 AS cluster FROM sc)",
    "cn AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS place FROM (SELECT DISTINCT cluster FROM cl))",
    "cw AS (SELECT cluster, rep, count(*) AS weight FROM (" + _draw_sql("(SELECT count(*) AS n FROM cn)", "n", "n") + ") JOIN cn USING (place) GROUP BY 1, 2)",
]


# --- injected gaps and result tables --------------------------------------------------------------------------------

CONDITIONS = (("MANY-SHORT", 2), ("MEDIUM", 6), ("FEW-LONG", 24))
SHARES = (0.05, 0.1)
CELLS = [{"condition": name, "share": share, "_length": length} for name, length in CONDITIONS for share in SHARES]


def _injected(spark, d, intact=None):
    """Copies of the hourly series with gaps of three lengths and two shares, all in one table. intact: the series, where a caller has them."""
    s = (series(spark, d) if intact is None else intact).select("series_id", "t", "v")
    got = inject.inject_stratified(s, F.col("share"), F.col("_length"), 5, K, cells=CELLS)
    return got.select("series_id", "t", "v", "condition", "share")


def inject_stratified(spark, d):
    return rounded(_injected(spark, d))


def _injected_sql() -> list[str]:
    parts = []
    for name, length in CONDITIONS:
        for share in SHARES:
            parts.append(f"""SELECT series_id, t, v, '{name}' AS condition, {share}::DOUBLE AS share FROM (SELECT *, stratum * width + 1 + ('0x' || substr(md5('5|' || series_id || '|' || stratum), 1, 8))::UBIGINT::BIGINT % greatest(1, width - {length} - 1) AS start FROM (SELECT *, i // width AS stratum FROM (SELECT *, n // strata AS width FROM (SELECT *, greatest(1, floor(n * {share}::DOUBLE / {length})::BIGINT) AS strata FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s))))) WHERE NOT (stratum < strata AND width > {length} + 1 AND i >= start AND i < start + {length})""")
    return ["ij AS (" + "\nUNION ALL ".join(parts) + ")"]


def _runs_table(spark, d):
    """One row for each (series, condition, share, week): error of persistence with the gaps over that without them.

    The series are written once for both: an hourly mean's last bit depends on the order in which its events arrive, so means made twice
    would give weeks that no gap touches a bias of some 1e-14, with a sign, in place of 0.
    """
    s = stored(series(spark, d), "series")
    keys = ["series_id", "condition", "share"]
    def by_week(df, keys):
        r = features.with_target(df, H, keys).where("target is not null")
        e = F.col("target") - F.col("v")
        return r.groupBy(*keys, F.floor(F.col("t") / 604800).alias("week")).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))

    intact = by_week(s, ["series_id"]).select("series_id", "week", F.col("rmse").alias("rmse_intact"))
    return by_week(_injected(spark, d, s), keys).join(intact, ["series_id", "week"]).withColumn("bias", 100 * (F.col("rmse") / F.col("rmse_intact") - 1))


_RUN_TABLE = [
    "ir AS (SELECT series_id, condition, share, t // 604800 AS week, sqrt(avg((target - v) * (target - v))) AS rmse, count(*) AS n FROM (SELECT *, lead(v) OVER (PARTITION BY series_id, condition, share ORDER BY t) AS target FROM ij) WHERE target IS NOT NULL GROUP BY 1, 2, 3, 4)",
    "it AS (SELECT series_id, t // 604800 AS week, sqrt(avg((target - v) * (target - v))) AS rmse_intact FROM (SELECT *, lead(v) OVER (PARTITION BY series_id ORDER BY t) AS target FROM s) WHERE target IS NOT NULL GROUP BY 1, 2)",
    "rt AS (SELECT ir.*, rmse_intact, 100 * (rmse / rmse_intact - 1) AS bias FROM ir JOIN it USING (series_id, week))",
]
_RT = [*SEGS[:2], *_injected_sql(), *_RUN_TABLE]


def injection_bias(spark, d):
    return rounded(_runs_table(spark, d).select("series_id", "condition", "share", "week", "n", "bias"), 5)


def cell_pivot_monotonic(spark, d):
    cells = summary.cell_means(_runs_table(spark, d), "bias", ["series_id", "share"], least=3)
    return summary.monotonic(cells, ["share"])


def cell_means(spark, d):
    c = summary.cell_means(_runs_table(spark, d), "bias", ["series_id", "share"], least=3)
    return rounded(c.withColumnsRenamed({"MANY-SHORT": "many_short", "MEDIUM": "medium", "FEW-LONG": "few_long"}), 5)


def survival_grid(spark, d):
    r = _runs_table(spark, d)
    grid = r.select("series_id").distinct().crossJoin(r.select("condition").distinct()).crossJoin(r.select("share").distinct())
    return summary.survival(r.where("bias > 0"), grid, ["series_id", "condition", "share"])


def summary_grouping_sets(spark, d):
    return rounded(summary.pooled(_runs_table(spark, d), "bias", [["condition", "share"], ["condition"], ["share"], []]), 5)


def reliability(spark, d):
    r = _runs_table(spark, d).withColumn("ok", summary.reliable(-F.col("bias"), F.col("rmse") / F.col("rmse_intact"), -10.0, 0.9, 1.1))
    return rounded(r.where("ok").groupBy("condition").agg(F.count("*").alias("n"), F.avg("bias").alias("mean")), 5)


def origin_summary(spark, d):
    return rounded(summary.origin_summary(_runs_table(spark, d), "bias", ["series_id", "condition"]), 5)


def sign_agreement(spark, d):
    return summary.sign_agreement(_runs_table(spark, d), "bias", ["series_id", "share"])


def spread(spark, d):
    return rounded(summary.spread(_runs_table(spark, d), "bias", ["series_id"]), 5)


def best_condition(spark, d):
    m = _runs_table(spark, d).groupBy("series_id", "condition", "share").agg(F.avg("bias").alias("bias"))
    return rounded(summary.best_of(m, "bias", ["condition", "share"], ["series_id"]), 5)


def long_numbers(spark, d):
    m = _runs_table(spark, d).groupBy("condition").agg(F.count("*").alias("n"), F.avg("bias").alias("mean"))
    return rounded(summary.long_form(m, ["condition"], ["n", "mean"]), 5)


def injected_gaps(spark, d):
    """Achieved missing share and number of segments of every injected copy."""
    i = _injected(spark, d)
    keys = ["series_id", "condition", "share"]
    lengths = segments.segment_lengths(segments.segment_ids(i, STEP, keys), keys)
    return lengths.groupBy(*keys).agg(F.sum("length").alias("n"), F.count("*").alias("segments"), F.max("length").alias("longest"))


# --- models ---------------------------------------------------------------------------------------------------------


def _modelling_rows(spark, d, depth=5):
    made = stored(features.build_features(segmented(spark, d), depth, OWN), "features")
    names = features.feature_names(depth)
    rows = origins.valid_origins(made, depth, SEQ, H)
    return stored(origins.gap_aware_split(rows, SEQ, H, **LEAST), "split-features"), names


def ridge_full(spark, d):
    """Skill of ridge on the whole feature set."""
    rows, names = _modelling_rows(spark, d)
    model = models.fit_ridge(rows.where("split = 'train'"), names)
    return rounded(scores.skill_summary(models.predict_ridge(rows.where("split = 'test'"), model, names)), 4)


def _trees(spark, d, kind, params):
    """Skill of trees fitted to each record by itself."""
    rows, names = _modelling_rows(spark, d)
    made = trees.predict_by_record(rows.withColumnRenamed("split", "role"), names, kind, K, **params)
    return rounded(scores.skill_summary(made), 4)


def gbt_skill(spark, d):
    return _trees(spark, d, "boosted", trees.BOOSTED)


def forest_skill(spark, d):
    return _trees(spark, d, "forest", trees.FOREST)


def arma_skill(spark, d):
    """ARMA(2, 1) on up to 301 rows of history within the segment, from at most 120 test origins a series at even strides: skill against persistence
    on the same origins, and at how many no forecast could be made."""
    rows = origins.gap_aware_split(valid_rows(spark, d, 30), SEQ, H, **LEAST).where("split = 'test'")
    stride = F.greatest(F.lit(1), F.floor(F.col("_c") / 120))
    some = stored(origins.numbered(rows).where((F.col("_r") % stride == 0) & (F.col("_r") < 120 * stride)).select("series_id", "t", "target"), "arma-origins")
    made = models.arma_predictions(stored(segmented(spark, d), "segments"), H)
    each = stored(some.join(made.select("series_id", "t", "v", "prediction"), ["series_id", "t"]), "arma-rows")
    failed = each.groupBy(*K).agg(F.count(F.when(F.col("prediction").isNull(), 1)).alias("failures"))
    return rounded(scores.skill_summary(each.where("prediction is not null")).join(failed, K), 4)


_ARMA_SUM = lambda k: f"coalesce(sum(v * {'v' if k == 0 else f'l{k}'}) OVER (PARTITION BY series_id, seg ORDER BY t ROWS BETWEEN {300 - k} PRECEDING AND CURRENT ROW), 0)"
_ARMA_COV = lambda k: f"(w{k} - mu * (2 * s1 - ({' + '.join(['0.0::DOUBLE', *[f'b[{i + 1}]' for i in range(k)]])}) - ({' + '.join(['0.0::DOUBLE', *[('v' if i == 0 else f'l{i}') for i in range(k)]])})) + (m - {k}) * mu * mu) / m"
_ARMA = [
    *SEGS, valid_sql(30), split_sql(),
    f"a1 AS (SELECT *, {', '.join(f'lag(v, {k}) OVER o AS l{k}' for k in range(1, 4))} FROM seg WINDOW o AS (PARTITION BY series_id, seg ORDER BY t))",
    f"a2 AS (SELECT *, list(v) OVER (PARTITION BY series_id, seg ORDER BY t ROWS BETWEEN 300 PRECEDING AND CURRENT ROW) AS b, sum(v) OVER (PARTITION BY series_id, seg ORDER BY t ROWS BETWEEN 300 PRECEDING AND CURRENT ROW) AS s1, list(v) OVER (PARTITION BY series_id, seg ORDER BY t ROWS BETWEEN {models.ERRORS + 2} PRECEDING AND CURRENT ROW) AS tail, {', '.join(f'{_ARMA_SUM(k)} AS w{k}' for k in range(4))} FROM a1)",
    f"a3 AS (SELECT *, {', '.join(f'{_ARMA_COV(k)} AS c{k}' for k in range(4))} FROM (SELECT *, s1 / m AS mu FROM (SELECT *, len(b)::DOUBLE AS m FROM a2)))",
    "a4 AS (SELECT *, r1 * (1 - f2) AS b1 FROM (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS f2 FROM (SELECT *, CASE WHEN c0 > 1e-12 THEN c1 / c0 END AS r1, CASE WHEN c0 > 1e-12 THEN c2 / c0 END AS r2, CASE WHEN c0 > 1e-12 THEN c3 / c0 END AS r3 FROM a3)))",
    f"a5 AS (SELECT *, a1 - theta AS p1, a2 + theta * a1 AS p2 FROM (SELECT *, greatest(-{models.THETA}::DOUBLE, least({models.THETA}::DOUBLE, CASE WHEN a2 = 0 THEN 0 ELSE -a3 / a2 END)) AS theta FROM (SELECT *, b1 - a3 * f2 AS a1, f2 - a3 * b1 AS a2 FROM (SELECT *, (r3 - b1 * r2 - f2 * r1) / (1 - b1 * r1 - f2 * r2) AS a3 FROM a4))))",
    "a6 AS (SELECT *, list_transform(tail, lambda x: x - mu) AS z FROM a5)",
    "a7 AS (SELECT *, list_reduce([0.0::DOUBLE] || list_transform(range(3, len(z) + 1), lambda j: z[j] - p1 * z[j - 1] - p2 * z[j - 2]), lambda e, x: x - theta * e) AS e FROM a6)",
    "am AS (SELECT series_id, t, CASE WHEN m >= 30 AND theta IS NOT NULL THEN mu + p1 * z[-1] + p2 * z[-2] + theta * e END AS p FROM a7)",
    "ao AS (SELECT q.series_id, q.t, v, target, p FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY series_id) // 120) AS stride FROM sp WHERE split = 'test') q JOIN am USING (series_id, t) WHERE i % stride = 0 AND i < 120 * stride)",
]


def inject_exact(spark, d):
    """A tenth of each series' samples taken away in gaps of about six: what is left, and in how many segments."""
    left = inject.inject_exact(series(spark, d), F.floor(F.col("n") / 10), F.lit(6), 42, 20)
    return segments.segment_lengths(segments.segment_ids(left, STEP)).groupBy("series_id").agg(F.sum("length").alias("n"), F.count("*").alias("segments"), F.max("length").alias("longest"))


_EXACT = [
    "pn AS (SELECT series_id, n, n // 10 AS dr, greatest(1, round_even((n // 10) / 6.0, 0))::BIGINT AS g FROM (SELECT series_id, count(*) AS n FROM s GROUP BY 1))",
    "pj AS (SELECT *, unnest(range(0, g)) AS j FROM (SELECT *, n - dr - 42 - (g - 1) AS room FROM pn) WHERE dr >= g AND room >= 0)",
    "pc AS (SELECT *, ('0x' || substr(md5('42|' || series_id || '|' || j), 1, 8))::UBIGINT::BIGINT % (room + 1) AS cut, ('0x' || substr(md5('43|' || series_id || '|' || j), 1, 8))::UBIGINT::BIGINT % 2147483648 AS turn FROM pj)",
    "pl AS (SELECT *, dr // g + CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY turn, j) <= dr % g THEN 1 ELSE 0 END AS length FROM pc)",
    "ps AS (SELECT series_id, length, 21 + cut + row_number() OVER w - 1 + coalesce(sum(length) OVER (PARTITION BY series_id ORDER BY cut, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pl WINDOW w AS (PARTITION BY series_id ORDER BY cut, j))",
    "ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i FROM s) ANTI JOIN (SELECT series_id, unnest(range(start::BIGINT, (start + length)::BIGINT)) AS i FROM ps) USING (series_id, i))",
]


def causality_check(spark, d):
    """For each series, up to eight instants (five places spread over it, its first three segments' starts): on how many the features
    change when all later rows are taken away. None may."""
    s = segmented(spark, d)
    names = features.feature_names(5)
    return features.causality_checks(s, lambda x, keys: features.build_features(x, 5, keys), names).groupBy("series_id").agg(F.count("*").alias("n_checked"), F.sum(F.col("wrong").cast("long")).alias("n_wrong"))


def _causal_sql() -> list[str]:
    f = lambda source, keys: f"SELECT *, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3, lag(v, 5) OVER w AS l5, CASE WHEN count(v) OVER f = 5 THEN avg(v) OVER f END AS m, CASE WHEN count(v) OVER f = 5 THEN stddev_samp(v) OVER f END AS sd FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t), f AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    same = " AND ".join(f"coalesce(abs(a.{x} - b.{x}) <= 1e-9, a.{x} IS NULL AND b.{x} IS NULL)" for x in ("v", "l1", "l2", "l3", "l5", "m", "sd"))
    return [
        "rn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS c, row_number() OVER (PARTITION BY series_id, seg ORDER BY t) AS p FROM seg)",
        "ct AS (SELECT DISTINCT series_id, t AS cut FROM rn WHERE r IN (c // 6, 2 * c // 6, 3 * c // 6, 4 * c // 6, 5 * c // 6) OR (p = 1 AND seg < 3))",
        f"fa AS ({f('seg', 'series_id, seg')})",
        "cu AS (SELECT seg.*, cut FROM seg JOIN ct USING (series_id) WHERE t <= cut)",
        f"fb AS ({f('cu', 'series_id, cut, seg')})",
        f"cc AS (SELECT a.series_id, NOT ({same}) AS wrong FROM fa a JOIN fb b ON a.series_id = b.series_id AND a.t = b.t AND b.t = b.cut)",
    ]


def t_interval(spark, d):
    """t interval over weeks, each condition by the number of its own."""
    r = _runs_table(spark, d)
    return rounded(summary.origin_summary(r.groupBy("condition", "week").agg(F.avg("bias").alias("bias")), "bias", ["condition"]), 5)


#: 97.5 % points of Student's t for 1 to 30 degrees of freedom. Fixed values.
T975 = (12.7062047361747, 4.30265272974946, 3.18244630528371, 2.77644510519779, 2.57058183563631, 2.44691185114497, 2.36462425159278, 2.30600413520417, 2.2621571627982, 2.22813885198627, 2.20098516009164, 2.17881282966723, 2.16036865646279, 2.1447866879178, 2.13144954555978, 2.11990529922126, 2.10981557783332, 2.10092204024104, 2.09302405440831, 2.08596344726586, 2.07961384472768, 2.07387306790403, 2.06865761041905, 2.06389856162803, 2.05953855275330, 2.05552943864287, 2.05183051648029, 2.04840714179525, 2.04522964213270, 2.04227245630124)


def _t_sql(n: str) -> str:
    return f"({list(T975)})[{n} - 1]"


def _normal_sf_sql(z: str) -> str:
    """P(Z > z): half less the density times sum z^(2k+1) / (2k+1)!!, whose terms are all of one sign."""
    return f"greatest(0.0::DOUBLE, 0.5 - sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-30)) - lgamma(2 * k + 2.0) + k * ln(2) + lgamma(k + 1.0)))))"


def _t_two_sided_sql(t: str, df: str) -> str:
    """P(|T| > t) for whole degrees of freedom, by the finite sums over powers of the cosine of atan(t / sqrt(df))."""
    c2, s = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    even = f"{s} * list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(2 * k + 1.0) - 2 * lgamma(k + 1.0) - k * ln(4) + k * ln({c2}))))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1.0) - lgamma(2 * k + 2.0) + (k + 0.5) * ln({c2})))), 0))"
    return f"greatest(0.0::DOUBLE, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


_MW = "mw AS (SELECT series_id, count(*) AS n, count(*) FILTER (g) AS n1, sum(r) FILTER (g) AS s, sum(k * k - 1)::DOUBLE AS ties FROM (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY sq_p) + (k - 1) / 2 AS r FROM (SELECT *, d <= 3 AS g, count(*) OVER (PARTITION BY series_id, sq_p) AS k FROM sc WHERE d <= 3 OR d > 8)) GROUP BY 1), mz AS (SELECT *, u0 AS u, CASE WHEN sp > 0 THEN (u0 - n1 * n2 / 2 - 0.5) / sp END AS z, CASE WHEN sp > 0 THEN (abs(u0 - n1 * n2 / 2) - 0.5) / sp END AS z2 FROM (SELECT *, s - n1 * (n1 + 1) / 2 AS u0, sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sp FROM (SELECT *, n - n1 AS n2 FROM mw)))"
_SIGN = "CASE WHEN bias > 0.005 THEN 1 WHEN bias < -0.005 THEN -1 ELSE 0 END"

QUERIES = {
    "dm_statistic": (dm_statistic, with_([*SCORES, *_hac_sql("sq_m - sq_p")], f"SELECT series_id, n, round(sqrt(greatest(1e-12, (n + 1 - {2 * H} + {H * (H - 1)} / n) / n)) * mean / sqrt(variance), 4) AS dm FROM hs")),
    "dm_p_value": (dm_p_value, with_([*SCORES, *_hac_sql("sq_m - sq_p"), f"dm AS (SELECT series_id, n, sqrt(greatest(1e-12, (n + 1 - {2 * H} + {H * (H - 1)} / n) / n)) * mean / sqrt(variance) AS dm FROM hs)"], f"SELECT series_id, n, round(dm, 6) AS dm, round({_t_two_sided_sql('dm', '(n - 1)')}, 6) AS p FROM dm")),
    "cw_p_value": (cw_p_value, with_([*SCORES, *_hac_sql("(target - v) * (target - v) - ((target - m5) * (target - m5) - (v - m5) * (v - m5))")], f"SELECT series_id, n, round({_normal_sf_sql('z')}, 6) AS p FROM (SELECT series_id, n, mean / sqrt(variance) AS z FROM hs)")),
    "pearson_p": (pearson_p, with_(SCORES, f"SELECT series_id, n, round(r, 6) AS r, round({_t_two_sided_sql('t', '(n - 2)')}, 6) AS p FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT series_id, count(*) AS n, corr(sq_m, d) AS r FROM sc GROUP BY 1))")),
    "mann_whitney_p": (mann_whitney_p, with_([*SCORES, _MW], f"SELECT series_id, n, round(u, 6) AS u, round({_normal_sf_sql('z')}, 6) AS p_greater, round(least(1, 2 * {_normal_sf_sql('abs(z2)')}), 6) AS p_two_sided FROM mz")),
    "gap_context_tests": (gap_context_tests, with_([*SEGS, LEN, DIST, _CTX, "cb AS (" + _CTX_ROWS + ")", "cm AS (SELECT series_id, kind, 'sd' AS measure, sd AS x FROM cb UNION ALL SELECT series_id, kind, 'ramp', ramp FROM cb)", "cr AS (SELECT series_id, measure, count(*) AS n, count(*) FILTER (g) AS n1, sum(r) FILTER (g) AS s, sum(k * k - 1)::DOUBLE AS ties FROM (SELECT *, kind = 'before gap' AS g, rank() OVER (PARTITION BY series_id, measure ORDER BY x) + (count(*) OVER (PARTITION BY series_id, measure, x) - 1) / 2 AS r, count(*) OVER (PARTITION BY series_id, measure, x) AS k FROM cm WHERE x IS NOT NULL) GROUP BY 1, 2)", "cz AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sp FROM (SELECT *, n - n1 AS n2 FROM cr) WHERE n1 >= 5 AND n2 >= 5)", f"cp AS (SELECT *, CASE WHEN z IS NOT NULL THEN {_normal_sf_sql('z')} END AS p FROM (SELECT *, CASE WHEN sp > 0 THEN (u - n1 * n2 / 2 - 0.5) / sp END AS z FROM cz))"], "SELECT series_id, measure, n1, n2, round(u, 5) AS u, round(p, 5) AS p, min(ok) OVER (ORDER BY p, series_id || '/' || measure ROWS UNBOUNDED PRECEDING) = 1 AS supported FROM (SELECT *, CASE WHEN p <= 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p, series_id || '/' || measure) + 1) THEN 1 ELSE 0 END AS ok FROM cp)")),
    "cw_statistic": (cw_statistic, with_([*SCORES, *_hac_sql("(target - v) * (target - v) - ((target - m5) * (target - m5) - (v - m5) * (v - m5))")], "SELECT series_id, n, round(mean / sqrt(variance), 4) AS cw FROM hs")),
    "mann_whitney_u": (mann_whitney_u, with_([*SCORES, _MW], "SELECT series_id, n, n1, n2, round(u, 4) AS u, round(z, 4) AS z FROM mz")),
    "holm": (holm, with_([*SCORES, _MW, f"pv AS (SELECT series_id, {_normal_sf_sql('z')} AS p FROM mz)"], "SELECT series_id, round(p, 5) AS p, min(ok) OVER (ORDER BY p, series_id ROWS UNBOUNDED PRECEDING) = 1 AS supported FROM (SELECT *, CASE WHEN p <= 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p, series_id) + 1) THEN 1 ELSE 0 END AS ok FROM pv)")),
    "spearman": (spearman, with_(SCORES, "SELECT series_id, count(*) AS n, round(corr(a, b), 5) AS rho FROM (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY d) + (count(*) OVER (PARTITION BY series_id, d) - 1) / 2 AS a, rank() OVER (PARTITION BY series_id ORDER BY sq_p) + (count(*) OVER (PARTITION BY series_id, sq_p) - 1) / 2 AS b FROM sc) GROUP BY 1")),
    "correlations": (correlations, with_(SCORES, "SELECT series_id, count(*) AS n, round(corr(sq_m, sq_p), 5) AS pearson, round(corr(ln(greatest(sq_m, 1e-4)), ln(greatest(sq_p, 1e-4))), 5) AS log_log FROM sc GROUP BY 1")),
    "segment_blocks": (segment_blocks, with_([*SCORES, _BLOCKS], "SELECT series_id, t, block FROM bk")),
    "bias_block_bootstrap": (bias_block_bootstrap, with_([*SCORES, *_BIAS], _pct("bias", "rp"))),
    "circular_bootstrap": (circular_bootstrap, with_([*SCORES, *_CIRC], _pct("rmse", "cr"))),
    "iid_bootstrap": (iid_bootstrap, with_([*SCORES, "iv AS (SELECT series_id, sq_p AS x, row_number() OVER (PARTITION BY series_id ORDER BY sq_p) - 1 AS place FROM sc WHERE displaced)", "rp AS (SELECT series_id, rep, avg(x) AS mean FROM (" + _draw_sql("(SELECT series_id, count(*) AS n FROM iv GROUP BY 1)", "n", "n") + ") JOIN iv USING (series_id, place) GROUP BY 1, 2)"], _pct("mean", "rp"))),
    "cluster_bootstrap": (cluster_bootstrap, with_([*SCORES, *_CLUST, "rp AS (SELECT series_id, rep, sum(s * weight) / sum(c * weight) AS mean FROM (SELECT series_id, cluster, sum(sq_p) AS s, count(*) AS c FROM cl GROUP BY 1, 2) JOIN cw USING (cluster) GROUP BY 1, 2)"], _pct("mean", "rp"))),
    "paired_difference": (paired_difference, with_([*SCORES, *_CLUST, "rp AS (SELECT series_id, rep, sum(s * weight) FILTER (displaced) / sum(c * weight) FILTER (displaced) - sum(s * weight) FILTER (NOT displaced) / sum(c * weight) FILTER (NOT displaced) AS diff FROM (SELECT series_id, displaced, cluster, sum(sq_p) AS s, count(*) AS c FROM cl GROUP BY 1, 2, 3) JOIN cw USING (cluster) GROUP BY 1, 2)"], _pct("diff", "rp"))),
    "inject_stratified": (inject_stratified, with_([*SEGS[:2], *_injected_sql()], "SELECT series_id, t, round(v, 6) AS v, condition, share FROM ij")),
    "injected_gaps": (injected_gaps, with_([*SEGS[:2], *_injected_sql()], f"SELECT series_id, condition, share, sum(length)::BIGINT AS n, count(*) AS segments, max(length) AS longest FROM (SELECT series_id, condition, share, seg, count(*) AS length FROM (SELECT *, sum(b) OVER (PARTITION BY series_id, condition, share ORDER BY t) AS seg FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id, condition, share ORDER BY t) <> {STEP} THEN 1 ELSE 0 END AS b FROM ij)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")),
    "injection_bias": (injection_bias, with_(_RT, "SELECT series_id, condition, share, week, n, round(bias, 5) AS bias FROM rt")),
    "cell_means": (cell_means, with_(_RT, "SELECT series_id, share, " + ", ".join(f"round(CASE WHEN count(bias) FILTER (condition = '{c}') >= 3 THEN avg(bias) FILTER (condition = '{c}') END, 5) AS {n}" for c, n in (("MANY-SHORT", "many_short"), ("MEDIUM", "medium"), ("FEW-LONG", "few_long"))) + " FROM rt GROUP BY 1, 2")),
    "cell_pivot_monotonic": (cell_pivot_monotonic, with_(_RT, "SELECT share, count(*) FILTER (a >= b AND b >= c) AS n_monotonic, count(*) AS n_cells FROM (SELECT series_id, share, avg(bias) FILTER (condition = 'MANY-SHORT') AS a, avg(bias) FILTER (condition = 'MEDIUM') AS b, avg(bias) FILTER (condition = 'FEW-LONG') AS c, min(k) AS k, count(DISTINCT condition) AS m FROM (SELECT *, count(*) OVER (PARTITION BY series_id, share, condition) AS k FROM rt) GROUP BY 1, 2) WHERE k >= 3 AND m = 3 GROUP BY 1")),
    "survival_grid": (survival_grid, with_(_RT, "SELECT series_id, condition, share, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT series_id FROM rt), (SELECT DISTINCT condition FROM rt), (SELECT DISTINCT share FROM rt)) LEFT JOIN (SELECT series_id, condition, share, count(*) AS n FROM rt WHERE bias > 0 GROUP BY 1, 2, 3) USING (series_id, condition, share)")),
    "summary_grouping_sets": (summary_grouping_sets, with_(_RT, "SELECT condition, share, count(bias) AS n, round(avg(bias), 5) AS mean, round(quantile_cont(bias, 0.5), 5) AS median FROM rt GROUP BY GROUPING SETS ((condition, share), (condition), (share), ())")),
    "reliability": (reliability, with_(_RT, "SELECT condition, count(*) AS n, round(avg(bias), 5) AS mean FROM rt WHERE -bias > -10 AND rmse / rmse_intact BETWEEN 0.9 AND 1.1 GROUP BY 1")),
    "origin_summary": (origin_summary, with_(_RT, f"SELECT series_id, condition, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(mean - half, 5) AS ci_lo, round(mean + half, 5) AS ci_hi, one_sign, mean - half > 0 OR mean + half < 0 AS excludes_zero FROM (SELECT *, {_t_sql('n')} * sd / sqrt(n) AS half FROM (SELECT series_id, condition, count(bias) AS n, avg(bias) AS mean, stddev_samp(bias) AS sd, count(DISTINCT {_SIGN}) = 1 AS one_sign FROM rt GROUP BY 1, 2))")),
    "sign_agreement": (sign_agreement, with_(_RT, f"SELECT series_id, share, count(*) AS n, count(DISTINCT {_SIGN}) = 1 AS agree FROM rt GROUP BY 1, 2")),
    "spread": (spread, with_(_RT, f"SELECT series_id, round(min(bias), 5) AS min, round(max(bias), 5) AS max, round(avg(bias), 5) AS mean, round(stddev_samp(bias), 5) AS sd, count(DISTINCT {_SIGN}) = 1 AS one_sign FROM rt GROUP BY 1")),
    "best_condition": (best_condition, with_(_RT, "SELECT series_id, condition, share, round(bias, 5) AS bias FROM (SELECT series_id, condition, share, avg(bias) AS bias FROM rt GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY bias, condition, share) = 1")),
    "long_numbers": (long_numbers, with_(_RT, "SELECT condition, 'n' AS stat, count(*)::DOUBLE AS value FROM rt GROUP BY 1 UNION ALL SELECT condition, 'mean', round(avg(bias), 5) FROM rt GROUP BY 1")),
    "t_interval": (t_interval, with_([*_RT, "wk AS (SELECT condition, week, avg(bias) AS bias FROM rt GROUP BY 1, 2)"], f"SELECT condition, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(mean - half, 5) AS ci_lo, round(mean + half, 5) AS ci_hi, one_sign, mean - half > 0 OR mean + half < 0 AS excludes_zero FROM (SELECT *, {_t_sql('n')} * sd / sqrt(n) AS half FROM (SELECT condition, count(bias) AS n, avg(bias) AS mean, stddev_samp(bias) AS sd, count(DISTINCT {_SIGN}) = 1 AS one_sign FROM wk GROUP BY 1))")),
    "ridge_full": (ridge_full, None),
    "gbt_skill": (gbt_skill, None),
    "forest_skill": (forest_skill, None),
    "arma_skill": (arma_skill, with_(_ARMA, "SELECT series_id, n, rmse_m, rmse_p, skill, failures FROM (SELECT series_id, count(*) AS n, round(sqrt(avg((target - p) * (target - p))), 4) AS rmse_m, round(sqrt(avg((target - v) * (target - v))), 4) AS rmse_p, round(100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))), 4) AS skill FROM ao WHERE p IS NOT NULL GROUP BY 1) JOIN (SELECT series_id, count(*) FILTER (p IS NULL) AS failures FROM ao GROUP BY 1) USING (series_id)")),
    "inject_exact": (inject_exact, with_([*SEGS[:2], *_EXACT], f"SELECT series_id, sum(length)::BIGINT AS n, count(*) AS segments, max(length) AS longest FROM (SELECT series_id, seg, count(*) AS length FROM (SELECT *, sum(b) OVER (PARTITION BY series_id ORDER BY t) AS seg FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t) <> {STEP} THEN 1 ELSE 0 END AS b FROM ex)) GROUP BY 1, 2) GROUP BY 1")),
    "causality_check": (causality_check, with_([*SEGS, *_causal_sql()], "SELECT series_id, count(*) AS n_checked, count(*) FILTER (wrong) AS n_wrong FROM cc GROUP BY 1")),
}


INJECTED = "inject_stratified injected_gaps injection_bias cell_means cell_pivot_monotonic survival_grid summary_grouping_sets reliability origin_summary sign_agreement spread best_condition long_numbers t_interval direction_test extreme_runs sign_against_mean origin_growth".split()


def with_value(query, var: ContextVar, value):
    """The query with var set while its plan is made."""

    def run(spark, d):
        token = var.set(value)
        try:
            return query(spark, d)
        finally:
            var.reset(token)

    return run


def every_type(queries: dict) -> dict:
    """NAME_every_type, as the queries on injected gaps of all types were first called, beside NAME."""
    return {f"{n}_every_type": queries[n] for n in INJECTED}


#: Replicates of the reference (N_BOOT, BOOT_N); intervals of a bias may draw five times as many.
FULL = {n: (2000, 1) for n in ("iid_bootstrap", "cluster_bootstrap", "paired_difference", "first_ratio_interval", "common_support")}
FULL |= {"circular_bootstrap": (500, 1)} | {n: (2000, 5) for n in ("bias_block_bootstrap", "block_sensitivity", "width_change", "intervals_excluding_zero")}


_USABLE = re.compile(r"(rp\d*) AS \((SELECT series_id, rep, 100 .*?HAVING sum\(n_a\) >= 0\.5 \* max\(t_a\) AND sum\(n_c\) >= 0\.5 \* max\(t_c\))\)", re.DOTALL)


def full_sql(sql: str | None, n: int, again: int) -> str | None:
    """A query's SQL with n replicates. Where a bias may draw again: the first n usable ones of again * n, and no interval from fewer than half."""
    if not sql:
        return None
    sql = sql.replace(f"unnest(range(0, {REPS})) AS rep", f"unnest(range(0, {n * again})) AS rep")
    if again > 1:
        sql = _USABLE.sub(rf"\1 AS (SELECT series_id, rep, bias FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rep) AS nth FROM (\2) WHERE bias IS NOT NULL) WHERE nth <= {n})", sql)
        for q, c in (("0.025", "ci_lo"), ("0.975", "ci_hi")):
            sql = sql.replace(f"round(quantile_cont(bias, {q}), 4) AS {c}", f"CASE WHEN count(bias) >= {n / 2} THEN round(quantile_cont(bias, {q}), 4) END AS {c}")
    return sql


def full_reps(queries: dict) -> dict:
    """NAME_full of each query with intervals: the same with the reference's replicates."""
    return {f"{k}_full": (with_value(queries[k][0], DRAWS, (n, again)), full_sql(queries[k][1], n, again)) for k, (n, again) in FULL.items()}
