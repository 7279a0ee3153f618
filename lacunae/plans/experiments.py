"""Queries that run whole experiments: sweeps over depths, origins, fills and block sizes, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import in_order, rmse, skill
from ..operators import bootstrap, features, grid, origins, scores, segments, summary
from ..sources.tables import shared_path, stored
from ..streaming import series as stream
from .base import EV, LEN, SCORES, SEGS, SEQ, STEP, H, events, grid_sql, naive_rows, rounded, s_sql, scored_rows, segmented, series, valid_sql, with_
from .inference import _CLUST, _RT, DRAWS, _clusters, _draw_sql, _pct, _runs_table, bias_interval
from .modelling import K, kalman_sql

BLOCK_SIZES = (12, 25, 50)
DEPTHS = (3, 5, 10, 15)


def block_sensitivity(spark, d):
    """Bias intervals for several block sizes."""
    out, rows = None, stored(scored_rows(spark, d), "scored")  # read once for each block size
    for size in BLOCK_SIZES:
        one = bias_interval(rows, size).withColumn("block", F.lit(size))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


def width_change(spark, d):
    return rounded(summary.widest_change(block_sensitivity(spark, d), ["series_id"]), 2)


def intervals_excluding_zero(spark, d):
    return summary.excluding_zero(block_sensitivity(spark, d), ["block"])


def _sensitivity_sql() -> list[str]:
    ctes = [*SCORES]
    for n in BLOCK_SIZES:
        ctes += [
            f"bk{n} AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY seg, p) - 1 AS block FROM (SELECT *, (row_number() OVER (PARTITION BY series_id, seg ORDER BY t) - 1) // {n} AS p FROM sc))",
            f"tb{n} AS (SELECT series_id, block AS place, count(*) AS n_c, sum(sq_m) AS m_c, sum(sq_p) AS p_c, count(*) FILTER (ok) AS n_a, coalesce(sum(sq_m) FILTER (ok), 0) AS m_a, coalesce(sum(sq_p) FILTER (ok), 0) AS p_a FROM (SELECT *, d > 5 AND NOT displaced AS ok FROM bk{n}) GROUP BY 1, 2)",
            f"tt{n} AS (SELECT series_id, count(*) AS n, sum(n_a) AS t_a, sum(n_c) AS t_c FROM tb{n} GROUP BY 1)",
            f"rp{n} AS (SELECT series_id, rep, 100 * (1 - sqrt(sum(m_c) / sum(p_c))) - 100 * (1 - sqrt(sum(m_a) / sum(p_a))) AS bias FROM (" + _draw_sql(f"tt{n}", "n", "n") + f") JOIN tb{n} USING (series_id, place) GROUP BY 1, 2 HAVING sum(n_a) >= 0.5 * max(t_a) AND sum(n_c) >= 0.5 * max(t_c))",
        ]
    return [*ctes, "bs AS (" + " UNION ALL ".join(f"SELECT *, {n} AS block FROM ({_pct('bias', f'rp{n}')})" for n in BLOCK_SIZES) + ")"]


def first_ratio_interval(spark, d):
    """Interval of the model's over the persistence's error ratio at d = 1, the far rows' errors held fixed."""
    s = scored_rows(spark, d)
    far = s.where("d > 8 and not displaced and to_gap > 1").groupBy("series_id").agg(F.sqrt(F.avg("sq_m")).alias("fm"), F.sqrt(F.avg("sq_p")).alias("fp"))
    place = F.row_number().over(in_order(K)) - 1
    one = s.where("d = 1").select("series_id", "sq_m", "sq_p", place.cast("bigint").alias("place"))
    one = one.withColumn("_n", F.count("*").over(Window.partitionBy(*K)))
    means = {m: F.sqrt(F.avg(m)) for m in ("sq_m", "sq_p")}
    rep = bootstrap.Drawn(one, "place", list(means), K).replicates(means, DRAWS.get()[0], 7).join(far, "series_id")
    rep = rep.withColumn("ratio", F.col("sq_m") / F.col("fm") / (F.col("sq_p") / F.col("fp")))
    return rounded(bootstrap.percentiles(rep, "ratio", K), 4)


def common_support(spark, d):
    """Interval of the mean over hour-of-day cells with equal weights: cells are averaged within each replicate."""
    c = _clusters(spark, d).withColumn("all", F.lit(0)).withColumn("cell", F.floor(F.pmod(F.col("t"), F.lit(86400)) / 21600))
    w = bootstrap.cluster_weights(c, DRAWS.get()[0], 7, ["all"])
    sums = c.groupBy("series_id", "cell", "cluster").agg(F.sum("sq_p").alias("s"), F.count("*").alias("n"))
    cells = bootstrap.weighed(sums, w, K, few=True).groupBy("series_id", "rep", "cell").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("m"))
    return rounded(bootstrap.percentiles(cells.groupBy("series_id", "rep").agg(F.avg("m").alias("mean")), "mean", K), 4)


def rolling_origin_skill(spark, d):
    """For six disjoint origins: skill of the 5-row mean on all test rows and on those that no gap touches."""
    s = scored_rows(spark, d)
    numbered = origins.numbered(s)
    w = origins.origin_windows(s).select("series_id", "origin", "start", "end")
    test = numbered.join(w, "series_id").where((F.col("_r") >= F.col("start")) & (F.col("_r") < F.col("end")))
    ok = (F.col("d") > 5) & ~F.col("displaced")
    part = lambda c: F.sum(F.when(ok, F.col(c)))
    return rounded(test.groupBy("series_id", "origin").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_valid"), skill(F.sum("sq_m"), F.sum("sq_p")).alias("skill_naive"), skill(part("sq_m"), part("sq_p")).alias("skill_valid")), 4)


def depth_sweep(spark, d):
    """For several feature depths: valid origins, exposure, persistence error on them and on all rows."""
    seg, out = segmented(spark, d), None
    e = F.col("target") - F.col("v")
    every = naive_rows(spark, d).where("target is not null").groupBy("series_id").agg(F.count("*").alias("n_naive"), rmse(e).alias("rmse_naive"))
    for w in DEPTHS:
        v = origins.valid_origins(seg, w, min(SEQ, w + 1), H).groupBy("series_id").agg(F.count("*").alias("n_valid"), rmse(e).alias("rmse_valid")).withColumn("w", F.lit(w))
        out = v if out is None else out.unionByName(v)
    joined = out.join(every, "series_id")
    return rounded(joined.withColumn("exposure", 1 - F.col("n_valid") / F.col("n_naive")), 5)


def interpolation_sensitivity(spark, d):
    """Persistence error with and without filled short gaps, side by side."""
    fine = 600
    s = series(spark, d, fine)
    filled = grid.fill_short_gaps(grid.reindex(s, fine), 3).where("v is not null").select("series_id", "t", "v")
    e = F.col("target") - F.col("v")
    both = s.select("series_id", "t", "v", F.lit(False).alias("filled")).unionByName(filled.withColumn("filled", F.lit(True)))
    rows = features.with_target(segments.segment_ids(both, fine, ["series_id", "filled"]), 1, ["series_id", "filled", "seg"]).where("target is not null")
    return rounded(rows.groupBy("series_id").pivot("filled", [False, True]).agg(F.count("v").alias("n"), rmse(e).alias("rmse")).withColumnsRenamed({"false_n": "n_raw", "false_rmse": "rmse_raw", "true_n": "n_filled", "true_rmse": "rmse_filled"}), 5)


def model_table(spark, d):
    """Persistence, last-5 mean and one-feature ridge on the same test rows: error, mean absolute error, skill."""
    rows = naive_rows(spark, d).where("target is not null and m5 is not null")
    split = origins.published_split(rows)
    ridge = scores.predict_ridge1(split.where("split = 'test'"), scores.fit_ridge1(split.where("split = 'train'"), "m5"), "m5")
    each = ridge.select("series_id", "target", "v", F.explode(F.map_from_arrays(F.array(F.lit("persistence"), F.lit("mean5"), F.lit("ridge1")), F.array("v", "m5", "prediction"))).alias("model", "p"))
    e, b = F.col("target") - F.col("p"), F.col("target") - F.col("v")
    return rounded(each.groupBy("series_id", "model").agg(F.count("*").alias("n"), rmse(e).alias("rmse"), F.avg(F.abs(e)).alias("mae"), skill(F.sum(e * e), F.sum(b * b)).alias("skill")), 5)


def record_diagnostics(spark, d):
    """Lag-1 autocorrelation, and the shift of mean and deviation from the first three quarters to the last."""
    s = origins.numbered(series(spark, d)).withColumn("p", F.lag("v").over(in_order(K)))
    late = F.col("_r") >= F.floor(F.col("_c") * 0.75)
    part = lambda f, c: f(F.when(c, F.col("v")))
    return rounded(s.groupBy("series_id").agg(F.corr("v", "p").alias("autocorrelation"), (part(F.avg, late) - part(F.avg, ~late)).alias("mean_shift"), (part(F.stddev_samp, late) / part(F.stddev_samp, ~late)).alias("sd_ratio")), 5)


def direction_test(spark, d):
    """Mean, deviation and count by share and condition, and whether many short and few long gaps point to opposite sides."""
    r = _runs_table(spark, d).groupBy("share", "condition").agg(F.avg("bias").alias("mean"), F.stddev_samp("bias").alias("sd"), F.count("*").alias("n"))
    at = lambda c: F.max(F.when(F.col("condition") == c, F.col("mean"))).over(Window.partitionBy("share"))
    return rounded(r.withColumn("opposite", at("MANY-SHORT") * at("FEW-LONG") < 0).withColumn("rank", F.array_position(F.array(*map(F.lit, summary.CONDITIONS)), F.col("condition"))), 5)


def extreme_runs(spark, d):
    """How many runs have a large bias, and the median bias within and beyond."""
    r, big = _runs_table(spark, d), F.abs(F.col("bias")) > 2
    return rounded(r.groupBy("condition").agg(F.count(F.when(big, 1)).alias("n_extreme"), F.percentile(F.when(big, F.col("bias")), 0.5).alias("median_extreme"), F.percentile(F.when(~big, F.col("bias")), 0.5).alias("median_other")), 5)


def sign_against_mean(spark, d):
    """How many runs of a group share their group mean's sign."""
    m = F.avg("bias").over(Window.partitionBy("series_id", "condition"))
    return _runs_table(spark, d).withColumn("m", m).groupBy("series_id", "condition").agg(F.count(F.when(F.signum("bias") == F.signum("m"), 1)).alias("n_same"), F.count("*").alias("n"))


def origin_growth(spark, d):
    """Deviation of the bias within series against over all, and the median growth of test rows from week to week."""
    r = _runs_table(spark, d)
    growth = F.col("n") / F.lag("n").over(Window.partitionBy("series_id", "condition", "share").orderBy("week"))
    g = r.withColumn("growth", growth)
    within = g.groupBy("condition", "series_id").agg(F.stddev_samp("bias").alias("sd"))
    within = within.groupBy("condition").agg(F.avg("sd").alias("sd_within"))
    return rounded(within.join(g.groupBy("condition").agg(F.stddev_samp("bias").alias("sd_all"), F.percentile("growth", 0.5).alias("growth")), "condition"), 5)


def top_gaps(spark, d):
    """The three longest gaps of each series, the earlier first among equal ones."""
    n = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("length"), "start"))
    g = segments.runs(grid.reindex(series(spark, d), STEP), F.col("v").isNull())
    return g.withColumn("place", n).where("place <= 3").select("series_id", "place", "length", "start")


def _counted(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The counts of a stream in complete mode after all that is there now: each batch's overwrite those before."""
    out = shared_path(spark, name)
    write = lambda counts, _: counts.write.mode("overwrite").parquet(f"{out}/rows")
    df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def _streamed(spark: SparkSession, df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """All that is there now, through the stream into Parquet of the shared folder."""
    out = out or shared_path(spark, name)
    q = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def stream_means(spark, d):
    """Hourly means by a watermarked stream; the bins that the watermark has passed."""
    s = events(spark, d).withColumn("ts", F.timestamp_seconds("t"))
    path = shared_path(spark, "events")
    s.select("series_id", "ts", "v").write.parquet(path)
    source = spark.readStream.schema("series_id string, ts timestamp, v double").parquet(path)
    means = _streamed(spark, stream.windowed_means(source, "1 hour", "0 seconds", K), "means")
    return rounded(means.select("series_id", F.unix_timestamp("ts").alias("t"), "v", "n"))


def stream_levels(spark, d):
    """Kalman level and distance from the last gap by a stateful stream over the hourly series."""
    path = shared_path(spark, "series")
    series(spark, d).write.parquet(path)
    source = spark.readStream.schema("series_id string, t bigint, v double").parquet(path)
    return rounded(_streamed(spark, stream.online_levels(source, STEP), "levels").select("series_id", "t", "kalman", "d"))


def stream_features(spark, d):
    """Lags, rolling statistics and level within segments by a stateful stream over the hourly series."""
    path = shared_path(spark, "series")
    series(spark, d).write.parquet(path)
    source = spark.readStream.schema("series_id string, t bigint, v double").parquet(path)
    made = _streamed(spark, stream.online_features(source, STEP, 5), "features")
    return rounded(made.select("series_id", "t", "d", "lag_5", "roll_mean_5", "roll_std_5", "shear", "turbulence", "kalman"), 5)


def stream_sessions(spark, d):
    """Segments by session windows: those that the watermark has closed."""
    path = shared_path(spark, "series")
    series(spark, d).withColumn("ts", F.timestamp_seconds("t")).write.parquet(path)
    source = spark.readStream.schema("series_id string, t bigint, v double, ts timestamp").parquet(path)
    closed = _streamed(spark, stream.sessions(source, "1 hour", "0 seconds", K), "sessions")
    return closed.select("series_id", "length", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"))


def stream_distance_profile(spark, d):
    """Persistence errors by distance from the last gap: a stream of forecasts meets the stream of observations, a second stream counts."""
    rows, place = scored_rows(spark, d), shared_path(spark, "forecasts")
    rows.select("series_id", F.timestamp_seconds(F.col("t") + H * STEP).alias("target_ts"), F.col("v").alias("prediction"), "d").write.parquet(f"{place}/forecasts")
    series(spark, d).select("series_id", F.timestamp_seconds("t").alias("ts"), "v").write.parquet(f"{place}/observations")
    forecasts = spark.readStream.schema("series_id string, target_ts timestamp, prediction double, d bigint").parquet(f"{place}/forecasts")
    observations = spark.readStream.schema("series_id string, ts timestamp, v double").parquet(f"{place}/observations")
    met = stream.online_errors(forecasts, observations, "1 hour", K)
    _streamed(spark, met, "met", f"{place}/met")
    again = spark.readStream.schema(met.schema).parquet(f"{place}/met/rows")
    counts = _counted(spark, stream.error_counters(again, K, 8), "counts")
    return rounded(stream.profile_of_counters(counts, K, 3), 5)


_FINE = 600
_FILL = "fl AS (SELECT series_id, t, CASE WHEN v IS NULL AND n1 - n0 - 1 <= 3 THEN v0 + (v1 - v0) * ((n - n0) / (n1 - n0)) ELSE v END AS v FROM (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(k IGNORE NULLS) OVER b AS n0, first_value(k IGNORE NULLS) OVER a AS n1 FROM (SELECT *, CASE WHEN v IS NOT NULL THEN n END AS k FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM g)) WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"


def _next_sql(source: str) -> str:
    return f"SELECT series_id, count(*) AS n, sqrt(avg((x - v) * (x - v))) AS rmse FROM (SELECT *, lead(v) OVER w AS x, lead(t) OVER w AS y FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE y = t + {_FINE} GROUP BY 1"


_SPLIT_FIT = "SELECT series_id, avg(m5) AS mx, avg(target) AS my, count(*) * covar_pop(m5, target) / (count(*) * var_pop(m5) + var_pop(m5)) AS b FROM ps WHERE split = 'train' GROUP BY 1"

QUERIES = {
    "block_sensitivity": (block_sensitivity, with_(_sensitivity_sql(), "SELECT * FROM bs")),
    "width_change": (width_change, with_(_sensitivity_sql(), "SELECT series_id, round(100 * (max(ci_hi - ci_lo) / min(ci_hi - ci_lo) - 1), 2) AS width_change FROM bs GROUP BY 1")),
    "intervals_excluding_zero": (intervals_excluding_zero, with_(_sensitivity_sql(), "SELECT block, count(*) FILTER (ci_lo > 0 OR ci_hi < 0) AS n_excluding, count(*) AS n FROM bs GROUP BY 1")),
    "first_ratio_interval": (first_ratio_interval, with_([*SCORES, "iv AS (SELECT series_id, sq_m, sq_p, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS place FROM sc WHERE d = 1)", "fr AS (SELECT series_id, sqrt(avg(sq_m)) AS fm, sqrt(avg(sq_p)) AS fp FROM sc WHERE d > 8 AND NOT displaced AND to_gap > 1 GROUP BY 1)", "rp AS (SELECT series_id, rep, sqrt(avg(sq_m)) / max(fm) / (sqrt(avg(sq_p)) / max(fp)) AS ratio FROM (" + _draw_sql("(SELECT series_id, count(*) AS n FROM iv GROUP BY 1)", "n", "n") + ") JOIN iv USING (series_id, place) JOIN fr USING (series_id) GROUP BY 1, 2)"], _pct("ratio", "rp"))),
    "common_support": (common_support, with_([*SCORES, *_CLUST, "rp AS (SELECT series_id, rep, avg(m) AS mean FROM (SELECT series_id, rep, cell, sum(s * weight) / sum(c * weight) AS m FROM (SELECT series_id, t % 86400 // 21600 AS cell, cluster, sum(sq_p) AS s, count(*) AS c FROM cl GROUP BY 1, 2, 3) JOIN cw USING (cluster) GROUP BY 1, 2, 3) GROUP BY 1, 2)"], _pct("mean", "rp"))),
    "rolling_origin_skill": (rolling_origin_skill, with_(SCORES, "SELECT series_id, o::INTEGER AS origin, count(*) AS n, count(*) FILTER (ok) AS n_valid, round(100 * (1 - sqrt(sum(sq_m) / sum(sq_p))), 4) AS skill_naive, round(100 * (1 - sqrt(sum(sq_m) FILTER (ok) / sum(sq_p) FILTER (ok))), 4) AS skill_valid FROM (SELECT *, d > 5 AND NOT displaced AS ok, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS c FROM sc), range(1, 7) x(o) WHERE r >= c // 2 + c // 12 * (o - 1) AND r < c // 2 + c // 12 * o GROUP BY 1, 2")),
    "depth_sweep": (depth_sweep, with_([*SEGS, *[valid_sql(w, min(SEQ, w + 1), H, f"va{w}") for w in DEPTHS]], "SELECT series_id, n_valid, round(rmse_valid, 5) AS rmse_valid, w, n_naive, round(rmse_naive, 5) AS rmse_naive, round(1 - n_valid / n_naive, 5) AS exposure FROM (" + " UNION ALL ".join(f"SELECT series_id, count(*) AS n_valid, sqrt(avg((target - v) * (target - v))) AS rmse_valid, {w} AS w FROM va{w} GROUP BY 1" for w in DEPTHS) + ") JOIN (SELECT series_id, count(*) AS n_naive, sqrt(avg((x - v) * (x - v))) AS rmse_naive FROM (SELECT *, lead(v) OVER (PARTITION BY series_id ORDER BY t) AS x FROM s) WHERE x IS NOT NULL GROUP BY 1) USING (series_id)")),
    "interpolation_sensitivity": (interpolation_sensitivity, with_([EV, s_sql(_FINE), grid_sql(_FINE), _FILL, "fv AS (SELECT * FROM fl WHERE v IS NOT NULL)"], f"SELECT series_id, a.n AS n_raw, round(a.rmse, 5) AS rmse_raw, b.n AS n_filled, round(b.rmse, 5) AS rmse_filled FROM ({_next_sql('s')}) a JOIN ({_next_sql('fv')}) b USING (series_id)")),
    "model_table": (model_table, with_([*SCORES, "ps AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 < floor(0.75 * count(*) OVER (PARTITION BY series_id)) THEN 'train' ELSE 'test' END AS split FROM sc)", f"pr AS (SELECT ps.*, my + b * (m5 - mx) AS r FROM ps JOIN ({_SPLIT_FIT}) USING (series_id) WHERE split = 'test')", "ea AS (SELECT series_id, target, v, 'persistence' AS model, v AS p FROM pr UNION ALL SELECT series_id, target, v, 'mean5', m5 FROM pr UNION ALL SELECT series_id, target, v, 'ridge1', r FROM pr)"], "SELECT series_id, model, count(*) AS n, round(sqrt(avg((target - p) * (target - p))), 5) AS rmse, round(avg(abs(target - p)), 5) AS mae, round(100 * (1 - sqrt(sum((target - p) * (target - p)) / sum((target - v) * (target - v)))), 5) + 0.0::DOUBLE AS skill FROM ea GROUP BY 1, 2")),
    "record_diagnostics": (record_diagnostics, with_(SEGS, "SELECT series_id, round(corr(v, p), 5) AS autocorrelation, round(avg(v) FILTER (late) - avg(v) FILTER (NOT late), 5) AS mean_shift, round(stddev_samp(v) FILTER (late) / stddev_samp(v) FILTER (NOT late), 5) AS sd_ratio FROM (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY t) AS p, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 >= floor(0.75 * count(*) OVER (PARTITION BY series_id)) AS late FROM s) GROUP BY 1")),
    "direction_test": (direction_test, with_(_RT, "SELECT share, condition, round(mean, 5) AS mean, round(sd, 5) AS sd, n, max(mean) FILTER (condition = 'MANY-SHORT') OVER w * max(mean) FILTER (condition = 'FEW-LONG') OVER w < 0 AS opposite, list_position(['MANY-SHORT', 'MEDIUM', 'FEW-LONG'], condition)::BIGINT AS rank FROM (SELECT share, condition, avg(bias) AS mean, stddev_samp(bias) AS sd, count(*) AS n FROM rt GROUP BY 1, 2) WINDOW w AS (PARTITION BY share)")),
    "extreme_runs": (extreme_runs, with_(_RT, "SELECT condition, count(*) FILTER (abs(bias) > 2) AS n_extreme, round(quantile_cont(bias, 0.5) FILTER (abs(bias) > 2), 5) AS median_extreme, round(quantile_cont(bias, 0.5) FILTER (abs(bias) <= 2), 5) AS median_other FROM rt GROUP BY 1")),
    "sign_against_mean": (sign_against_mean, with_(_RT, "SELECT series_id, condition, count(*) FILTER (sign(bias) = sign(m)) AS n_same, count(*) AS n FROM (SELECT *, avg(bias) OVER (PARTITION BY series_id, condition) AS m FROM rt) GROUP BY 1, 2")),
    "origin_growth": (origin_growth, with_(_RT, "SELECT condition, round(sd_within, 5) AS sd_within, round(sd_all, 5) AS sd_all, round(growth, 5) AS growth FROM (SELECT condition, avg(sd) AS sd_within FROM (SELECT condition, series_id, stddev_samp(bias) AS sd FROM rt GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT condition, stddev_samp(bias) AS sd_all, quantile_cont(g, 0.5) AS growth FROM (SELECT *, n / lag(n) OVER (PARTITION BY series_id, condition, share ORDER BY week) AS g FROM rt) GROUP BY 1) USING (condition)")),
    "top_gaps": (top_gaps, with_([*SEGS, LEN], f"SELECT series_id, place::INTEGER AS place, length, start FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY length DESC, start) AS place FROM (SELECT series_id, (start - e) // {STEP} - 1 AS length, e + {STEP} AS start FROM (SELECT *, lag(\"end\") OVER (PARTITION BY series_id ORDER BY start) AS e FROM len) WHERE e IS NOT NULL)) WHERE place <= 3")),
    "stream_means": (stream_means, with_([EV], f"SELECT series_id, t - t % {STEP} AS t, round(avg(v), 6) AS v, count(*) AS n FROM ev WHERE t - t % {STEP} + {STEP} <= (SELECT max(t) FROM ev) GROUP BY 1, 2")),
    "stream_levels": (stream_levels, with_([*SEGS, *kalman_sql("seg", "seg", "ks")], "SELECT series_id, t, round(x, 6) AS kalman, n AS d FROM ks", True)),
    "stream_features": (stream_features, with_([*SEGS, *kalman_sql("seg", "seg", "ks")], "SELECT series_id, t, d, lag_5, round(CASE WHEN c = 5 THEN m END, 5) AS roll_mean_5, round(CASE WHEN c = 5 THEN sd END, 5) AS roll_std_5, shear, round(CASE WHEN c = 5 THEN sd / (m + 1e-9) END, 5) AS turbulence, kalman FROM (SELECT series_id, t, row_number() OVER o AS d, round(lag(v, 5) OVER o, 5) AS lag_5, avg(v) OVER f AS m, stddev_samp(v) OVER f AS sd, count(v) OVER f AS c, round(v - lag(v) OVER o, 5) + 0.0::DOUBLE AS shear FROM seg WINDOW o AS (PARTITION BY series_id, seg ORDER BY t), f AS (PARTITION BY series_id, seg ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) JOIN (SELECT series_id, t, round(x, 5) AS kalman FROM ks) USING (series_id, t)", True)),
    "stream_sessions": (stream_sessions, with_([*SEGS, LEN], f"SELECT series_id, length, start, \"end\" FROM len WHERE \"end\" + {STEP} <= (SELECT max(t) FROM s)")),
    "stream_distance_profile": (stream_distance_profile, with_(SCORES, "SELECT series_id, d, n, round(rmse, 5) AS rmse, round(far_rmse, 5) AS far_rmse, n_far, round(100 * (rmse / far_rmse - 1), 5) AS inflation FROM (SELECT series_id, d, count(*) AS n, sqrt(avg(sq)) AS rmse FROM sc WHERE NOT displaced AND d <= 12 GROUP BY 1, 2 HAVING count(*) >= 3) JOIN (SELECT series_id, sqrt(avg(sq)) AS far_rmse, count(*) AS n_far FROM sc WHERE NOT displaced AND d > 8 GROUP BY 1) USING (series_id)")),
}
