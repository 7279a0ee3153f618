"""Gaps and islands: maximal runs of samples exactly one step apart, and what lies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_order, so_far
from ..sources.tables import stored
from .blocked import SPAN, in_blocks, placed, running
from .grid import KEYS, reindex
from .ranks import percentiles


def segment_ids(df: DataFrame, step: int, keys: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """seg: 0 for the first run of each series, one more after every difference other than step (also a shorter one).

    Rows are dealt by block of time and breaks counted there. One edge row a block (its first and last time, its breaks) carries the
    count on: only those edges, not the rows, are ordered along the whole series.
    """
    own = [*keys, "_k"]
    dealt = df.withColumn("_k", F.floor(F.col("t") / span))
    breaks = F.coalesce((F.col("t") - F.lag("t").over(in_order(own)) != step).cast("long"), F.lit(0))
    counted = dealt.withColumn("_b", breaks).withColumn("_in", F.sum("_b").over(so_far(own)))
    edges = counted.groupBy(*own).agg(F.min("t").alias("_first"), F.max("t").alias("_last"), F.sum("_b").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_k")
    joint = F.coalesce((F.col("_first") - F.lag("_last").over(order) != step).cast("long"), F.lit(0))
    edges = edges.withColumn("_joint", joint)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = edges.withColumn("_off", before + F.sum("_joint").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return in_blocks(counted, offsets, own, ["_off"]).withColumn("seg", F.col("_in") + F.col("_off")).drop("_k", "_b", "_in", "_off")


def segment_ids_blocked(df: DataFrame, step: int, keys: list[str] = KEYS, block: int = 86400) -> DataFrame:
    """segment_ids by blocks of a day."""
    return segment_ids(df, step, keys, block)


def segment_lengths(segmented: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return segmented.groupBy(*keys, "seg").agg(F.count("*").alias("length"), F.min("t").alias("start"), F.max("t").alias("end"))


def runs(df: DataFrame, ok: Column, keys: list[str] = KEYS) -> DataFrame:
    """Runs of rows on which ok holds: run number, length, first and last time.

    Two counts, of rows and of rows on which ok holds, run along the series by blocks of time; their difference is the same all along a
    run and larger in the next.
    """
    counted = running(df.select(*keys, "t", F.coalesce(ok, F.lit(False)).alias("_ok")), {"_all": F.lit(1).cast("bigint"), "_good": F.col("_ok").cast("bigint")}, keys).where("_ok")
    found = counted.groupBy(*keys, (F.col("_all") - F.col("_good")).alias("_isle")).agg(F.count("*").alias("length"), F.min("t").alias("start"), F.max("t").alias("end"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_isle")).cast("bigint")
    return found.select(*keys, nth.alias("run"), "length", "start", "end")


def gap_report(grid: DataFrame, step: int, keys: list[str] = KEYS) -> DataFrame:
    """Of a complete grid: intervals, valid, missing, percent, segments, longest run (days), gaps, median (min) and longest (h) gap."""
    grid = stored(grid.select(*keys, "t", "v"), "gap-grid")
    valid = runs(grid, F.col("v").isNotNull(), keys).groupBy(*keys).agg(F.count("*").alias("segments"), (F.max("length") * step / 86400).alias("longest_days"))
    lengths = runs(grid, F.col("v").isNull(), keys).select(*keys, "length")
    gaps = lengths.groupBy(*keys).agg(F.count("*").alias("n_gaps"), (F.max("length") * step / 3600).alias("max_gap_h"))
    median = percentiles(lengths, "length", {"_median": 0.5}, keys).select(*keys, (F.col("_median") * step / 60).alias("median_gap_min"))
    total = grid.groupBy(*keys).agg(F.count("*").alias("intervals"), F.count("v").alias("valid"))
    out = total.join(valid, keys, "left").join(gaps, keys, "left").join(median, keys, "left")
    missing = F.col("intervals") - F.col("valid")
    return out.select(*keys, "intervals", "valid", missing.alias("missing"), (100 * missing / F.col("intervals")).alias("pct_missing"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("longest_days", F.lit(0.0)).alias("longest_days"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), "median_gap_min", "max_gap_h")


def gap_statistics(df: DataFrame, step: int, keys: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """Of rows that are there: counts, completeness, moments, percentiles, and gap lengths in missing samples (diff / step - 1).

    Differences are taken within blocks of time, and between a block's first row and the last one before it from one row a block.
    """
    own = [*keys, "_k"]
    rows = stored(df.select(*keys, "t", "v").withColumn("_k", F.floor(F.col("t") / span)), "gap-rows")
    inside = rows.withColumn("_d", F.col("t") - F.lag("t").over(in_order(own))).select(*keys, "_d")
    edges = rows.groupBy(*own).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    between = edges.withColumn("_d", F.col("_a") - F.lag("_b").over(Window.partitionBy(*keys).orderBy("_k"))).select(*keys, "_d")
    gap = stored(inside.unionByName(between).where(F.col("_d") != step).select(*keys, (F.col("_d") / step - 1).alias("gap")), "gaps")
    whole = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.max("t") - F.min("t")) / 86400).alias("span_days"), (100 * F.count("*") / ((F.max("t") - F.min("t")) / step + 1)).alias("completeness"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    counts = gap.groupBy(*keys).agg(F.count("*").alias("_g"), F.max("gap").alias("gap_max"))
    out = whole.join(percentiles(rows, "v", {"p05": 0.05, "p95": 0.95}, keys), keys, "left").join(counts, keys, "left").join(percentiles(gap, "gap", {"gap_median": 0.5, "gap_p95": 0.95}, keys), keys, "left")
    n_gaps = F.coalesce("_g", F.lit(0))
    return out.select(*keys, "n", "span_days", "completeness", "mean", "sd", "min", "max", "p05", "p95", (n_gaps + 1).alias("segments"), n_gaps.alias("n_gaps"), (100 * n_gaps / F.col("n")).alias("pct_after_gap"), "gap_median", "gap_p95", "gap_max")


def longest_block(segmented: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of each series' longest segment; of equally long ones the first."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("length"), "start"))
    best = segment_lengths(segmented, keys).withColumn("_n", nth).where("_n = 1").select(*keys, "seg")
    return segmented.join(best, [*keys, "seg"], "left_semi")


def day_runs(days: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Runs of consecutive calendar days (column day, integers): first day and number of days."""
    island = F.col("day") - F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    return days.select(*keys, "day").distinct().withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("day").alias("first_day"), F.count("*").alias("n_days")).drop("_i")


def gap_distance(df: DataFrame, step: int, keys: list[str] = KEYS) -> DataFrame:
    """For each sample: d (its place after the last gap, from 1), gap_before (missing samples before its run; 0 for the first)
    and to_gap (steps to the next missing sample; 10^9 less its place in the series where no gap follows)."""
    return distances(stored(placed(df, step, keys), "placed"), step, keys).select(*keys, "t", "v", "seg", "d", "gap_before", "to_gap")


def distances(rows: DataFrame, step: int, keys: list[str] = KEYS) -> DataFrame:
    """rows (of blocked.placed, written) with d, gap_before and to_gap of gap_distance. A segment's neighbours come from one row a segment."""
    own = [*keys, "seg"]
    lengths = segment_lengths(rows, keys)
    order = Window.partitionBy(*keys).orderBy("seg")
    lengths = lengths.select(*own, F.coalesce((F.col("start") - F.lag("end").over(order)) / step - 1, F.lit(0.0)).cast("long").alias("gap_before"), F.lead("seg").over(order).isNotNull().alias("_more"), F.min("start").over(Window.partitionBy(*keys)).alias("_t0"))
    joined = rows.join(lengths, own)
    grid_place = (F.col("t") - F.col("_t0")) / step
    to_gap = F.when(F.col("_more"), F.col("_n") - F.col("_p")).otherwise(F.lit(1_000_000_000) - grid_place.cast("long"))
    return joined.withColumns({"d": F.col("_p") + 1, "to_gap": to_gap}).drop("_more", "_t0")


def label_changes(df: DataFrame, label: str, keys: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """Rows at which the label differs from the one before (the first row counts), and the whole as `a -> b -> c`.

    Found and joined by blocks of t; a series' blocks then give one text each to the whole.
    """
    own = [*keys, "_k"]
    rows = df.withColumn("_k", F.floor(F.col("t") / span))
    last = rows.groupBy(*own).agg(F.max(F.struct("t", F.col(label).alias("x")))["x"].alias("_last"))
    edges = last.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_k")))
    order = in_order(own)
    rows = rows.withColumns({"_in": F.lag(label).over(order), "_first": F.row_number().over(order) == 1})
    rows = in_blocks(rows, edges, own, ["_edge"]).withColumn("_p", F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_in")))
    changed = rows.where(F.col("_p").isNull() | (F.col(label) != F.col("_p")))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c.alias("x")))), lambda s: s["x"]), " -> ")
    parts = changed.groupBy(*own).agg(F.count("*").alias("_m"), joined(F.col(label).cast("string"), "t").alias("_path"), F.count(label).alias("_named"))
    named = F.when(F.col("_named") > 0, F.col("_path"))  # a part without labels has nothing to join
    return parts.groupBy(*keys).agg(F.sum("_m").alias("n_changes"), joined(named, "_k").alias("path"))


def retention(lengths: DataFrame, depth: Column, horizon: Column, keys: list[str] = KEYS) -> DataFrame:
    """Valid origins by formula: sum of max(0, L - W - H) over segments, and their share of one segment's of the same size."""
    valid = F.sum(F.greatest(F.lit(0), F.col("length") - F.col("w") - F.col("h")))
    whole = F.sum("length") - F.col("w") - F.col("h")
    return lengths.withColumn("w", depth).withColumn("h", horizon).groupBy(*keys, "w", "h").agg(valid.alias("n_valid"), F.when(whole > 0, valid / whole).alias("retention"))


def retention_curve(lengths: DataFrame, depths: list[int], horizons: list[int], keys: list[str] = KEYS) -> DataFrame:
    """retention over a grid of depths and horizons. It depends on their sum alone: lengths are counted, summed once for each
    sum that occurs, and the grid is laid out after the aggregate."""
    sizes = lengths.groupBy(*keys, "length").agg(F.count("*").alias("n"))
    totals = sorted({w + h for w in depths for h in horizons})
    each = sizes.withColumn("_s", F.explode(F.array(*map(F.lit, totals))))
    valid = F.sum(F.col("n") * F.greatest(F.lit(0), F.col("length") - F.col("_s")))
    sums = each.groupBy(*keys, "_s").agg(valid.alias("n_valid"), (F.sum(F.col("n") * F.col("length")) - F.col("_s")).alias("_whole"))
    known = F.array(*map(F.lit, depths))
    grid = sums.withColumn("h", F.explode(F.filter(F.array(*map(F.lit, horizons)), lambda h: F.array_contains(known, F.col("_s") - h))))
    return grid.select(*keys, (F.col("_s") - F.col("h")).alias("w"), "h", "n_valid", F.when(F.col("_whole") > 0, F.col("n_valid") / F.col("_whole")).alias("retention"))


def record_row(grid: DataFrame, present: DataFrame, step: int, keys: list[str] = KEYS) -> DataFrame:
    """Bad (there but invalid) against absent grid points, and longest runs with and without the bad ones."""
    known = present.select(*keys, "t").withColumn("_there", F.lit(True))
    marked = reindex(grid.where("v is not null"), step, keys).join(known, [*keys, "t"], "left")
    there, valid = F.coalesce("_there", F.lit(False)), F.col("v").isNotNull()
    counts = marked.groupBy(*keys).agg(F.sum((there & ~valid).cast("long")).alias("bad"), F.sum((~there & ~valid).cast("long")).alias("absent"))
    clean = runs(marked, valid, keys).groupBy(*keys).agg(F.max("length").alias("longest_clean"))
    apparent = runs(marked, valid | there, keys).groupBy(*keys).agg(F.max("length").alias("longest_apparent"))
    return counts.join(clean, keys).join(apparent, keys)
