"""Queries on grids and gap structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import seconds
from ..operators import grid, segments
from .base import BASE, DIST, EV, LEN, SEGS, STEP, events, grid_sql, rounded, s_sql, segmented, series, with_

FINE = 600
_FINE = [EV, s_sql(FINE)]
_G = [*BASE, grid_sql()]
_GF = [*_FINE, grid_sql(FINE)]


def _grid(spark, d, step=STEP):
    return grid.reindex(series(spark, d, step), step)


def range_qc(spark, d):
    e = events(spark, d).withColumn("kept", grid.in_range(F.col("v"), 0, 45))
    return e.groupBy("series_id").agg(F.count("*").alias("n"), F.count("kept").alias("n_kept"), F.max("kept").alias("top"))


def sentinels(spark, d):
    m = grid.mask_sentinels(events(spark, d))
    p = grid.require_packets(m.withColumn("packets", F.pmod("event_id", F.lit(7)).cast("int")), 3)
    return p.groupBy("series_id").agg(F.sum(F.col("masked").cast("long")).alias("n_masked"), F.sum(F.col("too_few").cast("long")).alias("n_few"), F.count("v").alias("n_left"))


def coerced(spark, d):
    o = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("series_id"), "event_id", F.when(F.col("event_id") % 11 == 0, "#N/A").otherwise(F.col("event_id").cast("string")).alias("x"), F.when(F.col("event_id") % 13 == 0, "no date").otherwise(F.date_format(F.col("ts"), "dd/MM/yyyy HH:mm:ss")).alias("w"))
    c = grid.coerce(o, "x", "w", "dd/MM/yyyy HH:mm:ss")
    return c.groupBy("series_id").agg(F.count("v").alias("n_values"), F.count("ts").alias("n_times"), F.count("*").alias("n"), F.sum(seconds(F.col("ts"))).alias("sum_t"))


def grid_resample(spark, d):
    return rounded(series(spark, d, FINE))


def grid_reindex(spark, d):
    return rounded(_grid(spark, d))


def snap_half_even(spark, d):
    s = grid.snap_to_grid(events(spark, d).withColumn("t", F.col("t") - F.pmod(F.col("t"), F.lit(300))), FINE)
    return s.groupBy("series_id", "t").agg(F.count("*").alias("n"), F.sum(F.col("on_grid").cast("long")).alias("n_on_grid"))


def dedupe_prefer_valid(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("v"))).withColumn("t", F.col("t") - F.pmod(F.col("t"), F.lit(STEP)))
    return grid.dedupe_prefer_valid(e, ["event_id"])


def dedupe_first(spark, d):
    return grid.dedupe_first(events(spark, d).withColumn("t", F.col("t") - F.pmod(F.col("t"), F.lit(STEP))), ["event_id"])


def fill_short_gaps(spark, d):
    return rounded(grid.fill_short_gaps(_grid(spark, d, FINE), 3))


def interpolation_audit(spark, d):
    return rounded(grid.interpolation_audit(_grid(spark, d, FINE), 3))


def week_excerpt(spark, d):
    return rounded(grid.week_excerpt(series(spark, d), STEP))


def calendar_slice(spark, d):
    return rounded(grid.between(series(spark, d), 1704412800, 1705017600))


def segment_ids(spark, d):
    return segmented(spark, d).select("series_id", "t", "seg")


def segment_ids_blocked(spark, d):
    return segments.segment_ids_blocked(series(spark, d), STEP).select("series_id", "t", "seg")


def segment_lengths(spark, d):
    return segments.segment_lengths(segmented(spark, d))


def valid_runs(spark, d):
    return segments.runs(_grid(spark, d), F.col("v") > 25).select("series_id", "run", "length", "start", "end")


def gap_report(spark, d):
    return rounded(segments.gap_report(_grid(spark, d, FINE), FINE))


def gap_statistics(spark, d):
    return rounded(segments.gap_statistics(series(spark, d), STEP))


def longest_block(spark, d):
    return rounded(segments.longest_block(segmented(spark, d)))


def day_runs(spark, d):
    days = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("series_id"), F.floor(seconds(F.col("o_orderdate")) / 86400).alias("day"))
    return segments.day_runs(days)


def distance_from_gap(spark, d):
    return rounded(segments.gap_distance(series(spark, d), STEP))


def label_changes(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    days = li.select(F.col("l_linestatus").alias("series_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"), "l_returnflag")
    one = days.groupBy("series_id", "t").agg(F.min("l_returnflag").alias("l_returnflag"))
    return segments.label_changes(one, "l_returnflag")


def record_rows(spark, d):
    e = events(spark, d)
    present = e.select("series_id", (F.col("t") - F.pmod(F.col("t"), F.lit(STEP))).alias("t")).distinct()
    good = grid.resample(e.withColumn("v", grid.in_range(F.col("v"), 0, 60)), STEP)
    return segments.record_row(good, present, STEP)


def retention_formula(spark, d):
    return rounded(segments.retention(segments.segment_lengths(segmented(spark, d)), F.lit(5), F.lit(1)))


def retention_curve(spark, d):
    return rounded(segments.retention_curve(segments.segment_lengths(segmented(spark, d)), list(range(1, 151)), list(range(1, 61))))


_RUNS = """ (SELECT series_id, run, count(*) AS length, min(t) AS start, max(t) AS "end" FROM (SELECT *, sum(st) OVER (PARTITION BY series_id ORDER BY t) AS run FROM (SELECT *, CASE WHEN ok AND NOT coalesce(lag(ok) OVER (PARTITION BY series_id ORDER BY t), false) THEN 1 ELSE 0 END AS st FROM (SELECT *, {ok} AS ok FROM {source}))) WHERE ok GROUP BY 1, 2)"""


def _runs(ok: str, source: str = "g") -> str:
    return _RUNS.format(ok=ok, source=source)


QUERIES = {
    "range_qc": (range_qc, with_([EV], "SELECT series_id, count(*) AS n, count(*) FILTER (v BETWEEN 0 AND 45) AS n_kept, max(v) FILTER (v BETWEEN 0 AND 45) AS top FROM ev GROUP BY 1")),
    "sentinels": (sentinels, with_([EV], "SELECT series_id, count(*) FILTER (v >= 100 OR v < 0) AS n_masked, count(*) FILTER (v < 100 AND v >= 0 AND event_id % 7 < 3) AS n_few, count(*) FILTER (v < 100 AND v >= 0 AND event_id % 7 >= 3) AS n_left FROM ev GROUP BY 1")),
    "coerced": (coerced, "SELECT event_type AS series_id, count(*) FILTER (event_id % 11 <> 0) AS n_values, count(*) FILTER (event_id % 13 <> 0) AS n_times, count(*) AS n, (sum(epoch_us(ts) // 1000000) FILTER (event_id % 13 <> 0))::BIGINT AS sum_t FROM events GROUP BY 1"),
    "grid_resample": (grid_resample, with_(_FINE, "SELECT series_id, t, round(v, 6) AS v FROM s")),
    "grid_reindex": (grid_reindex, with_(_G, "SELECT series_id, t, round(v, 6) AS v FROM g")),
    "snap_half_even": (snap_half_even, with_([EV], "SELECT series_id, (round_even((t - t % 300) / 600, 0) * 600)::BIGINT AS t, count(*) AS n, count(*) FILTER ((t - t % 300) % 600 = 0) AS n_on_grid FROM ev GROUP BY 1, 2")),
    "dedupe_prefer_valid": (dedupe_prefer_valid, with_([EV], f"SELECT series_id, t, v, event_id FROM (SELECT series_id, t - t % {STEP} AS t, CASE WHEN event_id % 3 <> 0 THEN v END AS v, event_id FROM ev) QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY v IS NULL, event_id) = 1")),
    "dedupe_first": (dedupe_first, with_([EV], f"SELECT series_id, t, v, event_id FROM (SELECT series_id, t - t % {STEP} AS t, v, event_id FROM ev) QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY event_id) = 1")),
    "fill_short_gaps": (fill_short_gaps, with_(_GF, """SELECT series_id, t, round(CASE WHEN fill THEN v0 + (v1 - v0) * ((n - n0) / (n1 - n0)) ELSE v END, 6) AS v, fill AS filled FROM (SELECT *, v IS NULL AND coalesce(n1 - n0 - 1 <= 3, false) AS fill FROM (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(k IGNORE NULLS) OVER b AS n0, first_value(k IGNORE NULLS) OVER a AS n1 FROM (SELECT *, CASE WHEN v IS NOT NULL THEN n END AS k FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM g)) WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))""")),
    "interpolation_audit": (interpolation_audit, with_([*_GF, "r AS" + _runs("v IS NULL")], "SELECT series_id, observed, filled, round(100 * filled / (observed + filled), 6) AS pct_filled FROM (SELECT series_id, count(v) AS observed FROM g GROUP BY 1) LEFT JOIN (SELECT series_id, sum(length) FILTER (length <= 3)::BIGINT AS filled FROM r GROUP BY 1) USING (series_id)")),
    "week_excerpt": (week_excerpt, with_(BASE, f"SELECT series_id, t, round(v, 6) AS v FROM (SELECT series_id, unnest(range(a, a + 604800, {STEP})) AS t FROM (SELECT series_id, greatest(lo, least(m, hi - 604800)) AS a FROM (SELECT series_id, t - t % 86400 AS m, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n, count(*) OVER (PARTITION BY series_id) AS c, min(t) OVER (PARTITION BY series_id) AS lo, max(t) OVER (PARTITION BY series_id) AS hi FROM s) WHERE n = c // 2 + 1))) LEFT JOIN s USING (series_id, t)")),
    "calendar_slice": (calendar_slice, with_(BASE, "SELECT series_id, t, round(v, 6) AS v FROM s WHERE t BETWEEN 1704412800 AND 1705017600")),
    "segment_ids": (segment_ids, with_(SEGS, "SELECT series_id, t, seg FROM seg")),
    "segment_ids_blocked": (segment_ids_blocked, with_(SEGS, "SELECT series_id, t, seg FROM seg")),
    "segment_lengths": (segment_lengths, with_([*SEGS, LEN], "SELECT * FROM len")),
    "valid_runs": (valid_runs, with_(_G, 'SELECT series_id, run::BIGINT AS run, length, start, "end" FROM' + _runs("coalesce(v > 25, false)"))),
    "gap_report": (gap_report, with_(_GF, f"""SELECT series_id, intervals, valid, intervals - valid AS missing, round(100 * (intervals - valid) / intervals, 6) AS pct_missing, segments, round(longest * {FINE} / 86400, 6) AS longest_days, coalesce(n_gaps, 0) AS n_gaps, round(med * {FINE} / 60, 6) AS median_gap_min, round(mx * {FINE} / 3600, 6) AS max_gap_h FROM (SELECT series_id, count(*) AS intervals, count(v) AS valid FROM g GROUP BY 1) JOIN (SELECT series_id, count(*) AS segments, max(length) AS longest FROM{_runs('v IS NOT NULL')} GROUP BY 1) USING (series_id) LEFT JOIN (SELECT series_id, count(*) AS n_gaps, quantile_cont(length, 0.5) AS med, max(length) AS mx FROM{_runs('v IS NULL')} GROUP BY 1) USING (series_id)""")),
    "gap_statistics": (gap_statistics, with_(BASE, f"""SELECT series_id, n, round(span / 86400, 6) AS span_days, round(100 * n / (span / {STEP} + 1), 6) AS completeness, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mi, 6) AS min, round(ma, 6) AS max, round(p05, 6) AS p05, round(p95, 6) AS p95, n_gaps + 1 AS segments, n_gaps, round(100 * n_gaps / n, 6) AS pct_after_gap, round(gm, 6) AS gap_median, round(g95, 6) AS gap_p95, round(gx, 6) AS gap_max FROM (SELECT series_id, count(*) AS n, max(t) - min(t) AS span, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS mi, max(v) AS ma, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95, count(gap) AS n_gaps, quantile_cont(gap, 0.5) AS gm, quantile_cont(gap, 0.95) AS g95, max(gap) AS gx FROM (SELECT *, CASE WHEN dt <> {STEP} THEN dt / {STEP} - 1 END AS gap FROM (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS dt FROM s)) GROUP BY 1)""")),
    "longest_block": (longest_block, with_([*SEGS, LEN], "SELECT series_id, t, round(v, 6) AS v, seg FROM seg SEMI JOIN (SELECT series_id, seg FROM len QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY length DESC, start) = 1) USING (series_id, seg)")),
    "day_runs": (day_runs, "SELECT series_id, min(day) AS first_day, count(*) AS n_days FROM (SELECT *, day - row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM (SELECT DISTINCT o_orderpriority AS series_id, epoch_us(o_orderdate) // 86400000000 AS day FROM orders)) GROUP BY series_id, i"),
    "distance_from_gap": (distance_from_gap, with_([*SEGS, LEN, DIST], "SELECT series_id, t, round(v, 6) AS v, seg, d, gap_before, to_gap FROM di")),
    "label_changes": (label_changes, "SELECT series_id, count(*) AS n_changes, string_agg(f, ' -> ' ORDER BY t) AS path FROM (SELECT *, lag(f) OVER (PARTITION BY series_id ORDER BY t) AS p FROM (SELECT l_linestatus AS series_id, l_orderkey * 10 + l_linenumber AS t, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)) WHERE p IS NULL OR f <> p GROUP BY 1"),
    "record_rows": (record_rows, with_([EV, f"good AS (SELECT series_id, t - t % {STEP} AS t, avg(v) AS v FROM ev WHERE v BETWEEN 0 AND 60 GROUP BY 1, 2)", grid_sql(source="good"), f"m AS (SELECT g.*, there IS NOT NULL AS there FROM g LEFT JOIN (SELECT DISTINCT series_id, t - t % {STEP} AS t, true AS there FROM ev) USING (series_id, t))"], f"SELECT series_id, bad, absent, longest_clean, longest_apparent FROM (SELECT series_id, count(*) FILTER (there AND v IS NULL) AS bad, count(*) FILTER (NOT there AND v IS NULL) AS absent FROM m GROUP BY 1) JOIN (SELECT series_id, max(length) AS longest_clean FROM{_runs('v IS NOT NULL', 'm')} GROUP BY 1) USING (series_id) JOIN (SELECT series_id, max(length) AS longest_apparent FROM{_runs('v IS NOT NULL OR there', 'm')} GROUP BY 1) USING (series_id)")),
    "retention_formula": (retention_formula, with_([*SEGS, LEN], "SELECT series_id, 5 AS w, 1 AS h, n_valid, round(CASE WHEN total - 6 > 0 THEN n_valid / (total - 6) END, 6) AS retention FROM (SELECT series_id, sum(greatest(0, length - 6))::BIGINT AS n_valid, sum(length) AS total FROM len GROUP BY 1)")),
    "retention_curve": (retention_curve, with_([*SEGS, LEN], "SELECT series_id, w::INTEGER AS w, h::INTEGER AS h, n_valid, round(CASE WHEN total - w - h > 0 THEN n_valid / (total - w - h) END, 6) AS retention FROM (SELECT series_id, w, h, sum(greatest(0, length - w - h))::BIGINT AS n_valid, sum(length) AS total FROM len, range(1, 151) a(w), range(1, 61) b(h) GROUP BY 1, 2, 3)")),
}
