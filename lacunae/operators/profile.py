"""Errors by distance from a gap, and what precedes gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_order, last_rows
from ..sources.tables import stored
from .blocked import SPAN, nearest, numbered, with_halo
from .grid import KEYS


def is_far(depth: int, horizon: int) -> Column:
    """Rows that no gap touches: d beyond the depth, target not displaced, next gap beyond the horizon."""
    return (F.col("d") > depth) & ~F.col("displaced") & (F.col("to_gap") > horizon)


def distance_profile(scored: DataFrame, depth: int, horizon: int, most: int = 12, least: int = 15, keys: list[str] = KEYS) -> DataFrame:
    """For d = 1..most: n, rmse, and inflation (percent over the far rows' rmse). scored: d, to_gap, displaced, sq."""
    root = lambda c: F.sqrt(F.avg(c))
    far = scored.where(is_far(depth, horizon)).groupBy(*keys).agg(root("sq").alias("far_rmse"), F.count("*").alias("n_far"))
    near = scored.where(F.col("d") <= most).groupBy(*keys, "d").agg(F.count("*").alias("n"), root("sq").alias("rmse")).where(F.col("n") >= least)
    return near.join(far, keys).withColumn("inflation", 100 * (F.col("rmse") / F.col("far_rmse") - 1))


def first_after_gap(scored: DataFrame, depth: int, horizon: int, least_far: int = 50, keys: list[str] = KEYS) -> DataFrame:
    """Inflation of model and persistence at d = 1 over far rows, their ratio and which is hurt more."""
    part = lambda cond, c: F.sqrt(F.avg(F.when(cond, F.col(c))))
    far, one = is_far(depth, horizon), F.col("d") == 1
    out = scored.groupBy(*keys).agg(F.count(F.when(far, 1)).alias("n_far"), F.count(F.when(one, 1)).alias("n_first"), *[part(c, s).alias(f"{s}_{n}") for c, n in ((far, "far"), (one, "first")) for s in ("sq_m", "sq_p")])
    out = out.where(F.col("n_far") > least_far)
    m, p = F.col("sq_m_first") / F.col("sq_m_far"), F.col("sq_p_first") / F.col("sq_p_far")
    return out.select(*keys, "n_far", "n_first", m.alias("model_ratio"), p.alias("persistence_ratio"), (m / p).alias("ratio"), F.when(m > p, "model").when(m < p, "persistence").otherwise("equal").alias("hurt_more"))


def displaced_errors(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts and errors of rows with displaced targets against the others."""
    part = lambda cond, c: F.sqrt(F.avg(F.when(cond, F.col(c))))
    moved = F.col("displaced")
    return scored.groupBy(*keys).agg(F.count(F.when(moved, 1)).alias("n_displaced"), F.count(F.when(~moved, 1)).alias("n_kept"), part(moved, "sq").alias("rmse_displaced"), part(~moved, "sq").alias("rmse_kept"))


def lead_time_classes(naive: DataFrame, valid: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """kind of each naive test row: valid, input-only (its features reach over a gap) or target-crossing."""
    marks = valid.select(*keys, "t").withColumn("_ok", F.lit(True))
    kind = F.when(F.col("_ok"), "valid").when(F.col("displaced"), "target-crossing").otherwise("input-only")
    return naive.join(marks, [*keys, "t"], "left").withColumn("kind", kind).drop("_ok")


def staleness(scored: DataFrame, step: int, horizon: int, least: int = 15, keys: list[str] = KEYS) -> DataFrame:
    """Error by how many samples late the target is: bins 0, 1-3, 4-12, 13-72, over 72."""
    late = (F.col("target_t") - F.col("t")) / step - horizon
    name = F.when(late <= 0, "0").when(late <= 3, "1-3").when(late <= 12, "4-12").when(late <= 72, "13-72").otherwise(">72")
    return scored.withColumn("late", name).groupBy(*keys, "late").agg(F.count("*").alias("n"), F.sqrt(F.avg("sq")).alias("rmse")).where(F.col("n") >= least)


def far_from_gap_starts(df: DataFrame, starts: DataFrame, width: int, step: int, keys: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """Rows of df with no gap start within `width` steps: starts (keys, t) are merged into the rows, and the nearest on either side is
    carried to each (blocked.nearest), instead of a band join."""
    both = df.withColumn("_g", F.lit(None).cast("bigint")).withColumn("_own", F.lit(True)).unionByName(starts.select(*keys, "t").withColumn("_g", F.col("t")).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    got = nearest(both, "_g", keys, span, [F.col("_own")])
    near = F.coalesce(F.col("t") - F.col("_before") <= width * step, F.lit(False)) | F.coalesce(F.col("_after") - F.col("t") <= width * step, F.lit(False))
    return got.where(F.col("_own") & ~near).select(df.columns)


def pre_gap_context(distances: DataFrame, width: int, step: int, keys: list[str] = KEYS) -> DataFrame:
    """sd (population) and ramp (largest step change) over the last `width` samples, for rows at the end of a run (before a gap)
    and for baseline rows every `width` samples that have no gap start within `width`."""
    own = [*keys, "seg"]
    over = last_rows(own, width)
    change = F.abs(F.col("v") - F.lag("v").over(in_order(own)))
    d = distances.withColumn("_ch", F.when(F.col("d") > 1, change))
    d = d.withColumn("sd", F.when(F.count("v").over(over) == width, F.stddev_pop("v").over(over)))
    d = d.withColumn("ramp", F.when(F.count("v").over(over) == width, F.max("_ch").over(last_rows(own, width - 1))))
    ends = d.where((F.col("to_gap") == 1) & F.col("sd").isNotNull())
    starts = d.where(F.col("to_gap") == 1).select(*keys, (F.col("t") + step).alias("t"))
    base = far_from_gap_starts(d.where((F.pmod(F.col("d"), F.lit(width)) == 0) & F.col("sd").isNotNull()), starts, width, step, keys)
    pick = lambda df, name: df.select(*keys, "t", "sd", "ramp", F.lit(name).alias("kind"))
    return pick(ends, "before gap").unionByName(pick(base, "baseline"))


def context_windows(grid: DataFrame, width: int, step: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, method, before_gap, sd (population) and ramp (largest) of the one-step changes in windows of `width` samples of a complete grid.

    clean: windows that end right before a gap, and baseline windows at every `width` samples whose end has no gap start within width; all samples
    must be there. legacy: what is there of a window before a gap (at least 5 and half of it), whose changes may so span earlier
    gaps, and baseline windows at every half width wherever gaps start. Windows are made in blocks of rows with a halo.
    """
    halo = with_halo(numbered(grid.select(*keys, "t", "v"), keys), width - 1, 1)
    own = [*keys, "_blk"]
    ends = F.col("v").isNotNull() & F.lead("t").over(in_order(own)).isNotNull() & F.lead("v").over(in_order(own)).isNull()
    rows = halo.withColumns({"_ends": ends, "_a": F.collect_list("v").over(last_rows(own, width)), "_j": F.col("_r") + 1}).where("_own")
    half = max(1, width // 2)
    full, more = F.size("_a") == width, F.col("_j") < F.col("_c")
    rows = stored(rows.where(F.col("_ends") | (full & more & ((F.col("_j") % width == 0) | (F.pmod(F.col("_j") - width, F.lit(half)) == 0)))), "context-rows")
    starts = rows.where("_ends").select(*keys, (F.col("t") + step).alias("t"))
    clean = rows.where(full & more & (F.col("_j") % width == 0)).withColumn("t", F.col("t") + step)
    parts = (
        ("clean", True, rows.where(F.col("_ends") & full)), ("legacy", True, rows.where(F.col("_ends") & (F.size("_a") >= max(5, width // 2)))),
        ("clean", False, far_from_gap_starts(clean, starts, width, step, keys)), ("legacy", False, rows.where(full & more & (F.col("_j") >= width) & (F.pmod(F.col("_j") - width, F.lit(half)) == 0))),
    )
    out = None
    for method, before, df in parts:
        one = df.select(*keys, F.lit(method).alias("method"), F.lit(before).alias("before_gap"), "_a")
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("_b", F.expr("transform(sequence(1, size(_a) - 1), k -> _a[k] - _a[k - 1])"))
    mean = F.expr("aggregate(_b, 0D, (s, x) -> s + x) / size(_b)")
    out = out.withColumn("_m", mean).withColumn("sd", F.expr("sqrt(aggregate(_b, 0D, (s, x) -> s + (x - _m) * (x - _m)) / size(_b))"))
    return out.withColumn("ramp", F.expr("array_max(transform(_b, x -> abs(x)))")).drop("_a", "_b", "_m")
