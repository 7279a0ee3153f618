"""Controlled gaps: which samples of a contiguous series to take away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocked import numbered
from .bootstrap import draw
from .grid import KEYS


def plan_gaps(sizes: DataFrame, drop: Column, nominal: Column, seed: int, margin: int = 200, keys: list[str] = KEYS) -> DataFrame:
    """keys, start, length: gaps that take away exactly `drop` of each series' n samples, in about drop / nominal gaps.

    sizes: keys, n. Lengths differ by one at most. What stays free is shared out between the gaps: as many cuts as there are gaps are
    drawn in the free samples, and in order of the cuts each gap follows its own, a sample at least after the gap before and more than
    `margin` samples from either end. So every gap has a place at the first try. Series without enough room, or with nothing to drop,
    get no gaps. Cuts are hashes of seed, series and gap, so that reruns and other engines plan alike.
    """
    p = sizes.select(*keys, "n", drop.cast("bigint").alias("_d"), nominal.cast("double").alias("_l"))
    p = p.withColumn("_g", F.greatest(F.lit(1), F.bround(F.col("_d") / F.col("_l"))).cast("bigint"))
    p = p.withColumn("_room", F.col("n") - F.col("_d") - 2 * (margin + 1) - (F.col("_g") - 1)).where((F.col("_d") >= F.col("_g")) & (F.col("_room") >= 0))
    p = p.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_g") - 1)))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    p = p.withColumn("_cut", draw(seed, name, F.col("_j"), F.col("_room") + 1)).withColumn("_turn", draw(seed + 1, name, F.col("_j"), F.lit(1 << 31)))
    every = Window.partitionBy(*keys)
    longer = F.row_number().over(every.orderBy("_turn", "_j")) <= F.col("_d") % F.col("_g")
    p = p.withColumn("length", F.floor(F.col("_d") / F.col("_g")) + longer.cast("bigint"))
    order = every.orderBy("_cut", "_j")
    taken = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.select(*keys, (F.lit(margin + 1) + F.col("_cut") + F.row_number().over(order) - 1 + taken).alias("start"), "length")


def drop_intervals(df: DataFrame, gaps: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """df without the rows whose place (from 0, in time order) lies in one of the intervals (keys, start, length)."""
    hit = gaps.select(*keys, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("_r")).distinct()
    return numbered(df, keys).join(hit, [*keys, "_r"], "left_anti").drop("_r", "_c")


def inject_exact(df: DataFrame, drop: Column, nominal: Column, seed: int, margin: int = 200, keys: list[str] = KEYS) -> DataFrame:
    """df with gaps as plan_gaps makes them for its series; drop and nominal may use n, the series' size, and the keys."""
    return drop_intervals(df, plan_gaps(df.groupBy(*keys).agg(F.count("*").alias("n")), drop, nominal, seed, margin, keys), keys)


def inject_stratified(df: DataFrame, share: float | Column, length: int | Column, seed: int, keys: list[str] = KEYS, tag: str = "series_id", cells: list[dict] | None = None) -> DataFrame:
    """One gap of a given length in each of equal strata, at a hashed place within it: no two overlap or touch the ends.

    A variant whose gaps are spread more evenly than by free placement. cells: columns of several copies of df to be made, each with its
    own gaps (share and length then are columns of them); rows are numbered once for all copies.
    """
    placed = numbered(df, keys)
    if cells:
        made = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in cells])
        placed = placed.withColumn("_cell", F.explode(made)).select("*", "_cell.*").drop("_cell")
    share, length = (x if isinstance(x, Column) else F.lit(x) for x in (share, length))
    strata = F.greatest(F.lit(1), F.floor(F.col("_c") * share / length))
    width = F.floor(F.col("_c") / strata)
    stratum = F.floor(F.col("_r") / width)
    start = stratum * width + 1 + draw(seed, F.col(tag), stratum.cast("bigint"), F.greatest(F.lit(1), width - length - 1).cast("bigint"))
    gone = (stratum < strata) & (width > length + 1) & (F.col("_r") >= start) & (F.col("_r") < start + length)
    return placed.where(~gone).drop("_r", "_c")
