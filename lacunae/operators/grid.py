"""From raw observations to a regular grid: quality control, bins, snapping, de-duplication, complete grids, short-gap filling.

A series is rows (keys, t, v): t whole seconds, v double, null where a grid point has no measurement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, floor_to, snap
from .blocked import SPAN, in_blocks


def in_range(v: Column, low: float = 0.0, high: float = 45.0) -> Column:
    """The value within physical limits (both included), else null."""
    return F.when(v.between(low, high), v)


def mask_sentinels(df: DataFrame, high: float = 100.0) -> DataFrame:
    """Values from high on or below 0 become null; `masked` marks them."""
    bad = (F.col("v") >= high) | (F.col("v") < 0)
    return df.withColumn("masked", F.coalesce(bad, F.lit(False))).withColumn("v", F.when(~F.coalesce(bad, F.lit(False)), F.col("v")))


def require_packets(df: DataFrame, least: int, packets: str = "packets") -> DataFrame:
    """Values averaged from too few packets become null; `too_few` marks values that were there."""
    few = F.col("v").isNotNull() & (F.col(packets) < least)
    return df.withColumn("too_few", F.coalesce(few, F.lit(False))).withColumn("v", F.when(~F.coalesce(few, F.lit(False)), F.col("v")))


def coerce(df: DataFrame, value: str, time: str, fmt: str) -> DataFrame:
    """Text columns to v (double) and ts (timestamp without zone); what can't be read is null."""
    return df.withColumn("v", F.expr(f"try_cast(`{value}` AS double)")).withColumn("ts", F.try_to_timestamp(F.col(time), F.lit(fmt)).cast("timestamp_ntz"))


def resample(df: DataFrame, step: int, keys: list[str] = KEYS, order: str | None = None) -> DataFrame:
    """Mean of each left-closed bin that has values, labelled by its start. Map-side sums: one small shuffle.

    order: a column by which a bin's values are added one after the other, for what hangs on a mean's last bit (ranks); all values are then shuffled."""
    rows, bins = df.where("v is not null"), floor_to(F.col("t"), step).alias("t")
    if order is None:
        return rows.groupBy(*keys, bins).agg(F.avg("v").alias("v"))
    each = rows.groupBy(*keys, bins).agg(F.sort_array(F.collect_list(F.struct(order, "v"))).alias("_each"))
    return each.withColumn("v", F.aggregate("_each", F.lit(0.0), lambda total, one: total + one["v"]) / F.size("_each")).drop("_each")


def snap_to_grid(df: DataFrame, step: int) -> DataFrame:
    """t moved to the nearest grid point (halves to even); `on_grid` tells whether it was there already."""
    return df.withColumn("on_grid", F.pmod(F.col("t"), F.lit(step)) == 0).withColumn("t", snap(F.col("t"), step))


def dedupe_first(df: DataFrame, order: list, keys: list[str] = KEYS) -> DataFrame:
    """Of rows with one time the first in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys, "t").orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def dedupe_prefer_valid(df: DataFrame, order: list, keys: list[str] = KEYS) -> DataFrame:
    """As dedupe_first, but a measurement goes before a missing value."""
    return dedupe_first(df, [F.col("v").isNull(), *order], keys)


def reindex(df: DataFrame, step: int, keys: list[str] = KEYS, block: int = 1 << 16) -> DataFrame:
    """All grid points between a series' first and last, v null where it has none.

    Points are generated in blocks, so a long series doesn't come from one row or task.
    """
    ends = df.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    width = block * step
    blocks = ends.withColumn("_k", F.explode(F.expr(f"sequence(_a, _b, {width}L)")))
    points = blocks.select(*keys, F.explode(F.expr(f"sequence(_k, least(_b, _k + {width - step}L), {step}L)")).alias("t"))
    return points.join(df, [*keys, "t"], "left")


def fill_short_gaps(df: DataFrame, limit: int, keys: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """Linear fill of runs of at most limit nulls that have values on both sides; `filled` marks them. df is a complete grid.

    Rows are dealt by block of time. A gap's neighbours come from two running passes within the block, one in either direction, and beyond
    its edges from one row a block, which are ordered along the series with the counts that number the rows.
    """
    own = [*keys, "_k"]
    order, back = Window.partitionBy(*own).orderBy("t"), Window.partitionBy(*own).orderBy(F.desc("t"))
    here, earlier = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    dealt = df.withColumn("_k", F.floor(F.col("t") / span)).withColumn("_i", F.row_number().over(order).cast("long"))
    dealt = dealt.withColumn("_at", F.when(F.col("v").isNotNull(), F.struct(F.col("_i").alias("i"), "v")))
    known = dealt.withColumns({"_x0": F.last("_at", True).over(order.rowsBetween(*here)), "_x1": F.last("_at", True).over(back.rowsBetween(*here))})
    edges = dealt.groupBy(*own).agg(F.count("*").alias("_m"), F.max("_at").alias("_l"), F.min("_at").alias("_f"))
    along, across = Window.partitionBy(*keys).orderBy("_k"), Window.partitionBy(*keys).orderBy(F.desc("_k"))
    edges = edges.withColumn("_off", F.coalesce(F.sum("_m").over(along.rowsBetween(*earlier)), F.lit(0)))
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col("_off") + F.col(f"{c}.i")).alias("i"), F.col(f"{c}.v").alias("v")))
    edges = edges.withColumns({"_e0": F.last(place("_l"), True).over(along.rowsBetween(*earlier)), "_e1": F.last(place("_f"), True).over(across.rowsBetween(*earlier))})
    got = in_blocks(known, edges, own, ["_off", "_e0", "_e1"])
    n, off = F.col("_off") + F.col("_i"), F.col("_off")
    n0, v0 = F.coalesce(off + F.col("_x0.i"), F.col("_e0.i")), F.coalesce("_x0.v", "_e0.v")
    n1, v1 = F.coalesce(off + F.col("_x1.i"), F.col("_e1.i")), F.coalesce("_x1.v", "_e1.v")
    fill = F.col("v").isNull() & n0.isNotNull() & n1.isNotNull() & (n1 - n0 - 1 <= limit)
    line = v0 + (v1 - v0) * ((n - n0) / (n1 - n0))
    at = df.columns.index("v")
    return got.select(*df.columns[:at], F.when(fill, line).otherwise(F.col("v")).alias("v"), *df.columns[at + 1 :], fill.alias("filled"))


def between(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of a calendar window, both ends included."""
    return df.where(F.col("t").between(start, end))


def week_excerpt(df: DataFrame, step: int, days: int = 7, keys: list[str] = KEYS) -> DataFrame:
    """The complete grid of `days` days from the midnight before each series' middle sample, kept within the series."""
    n = Window.partitionBy(*keys)
    numbered = df.withColumn("_n", F.row_number().over(n.orderBy("t"))).withColumn("_c", F.count("*").over(n))
    bounds = df.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    middle = numbered.where(F.col("_n") == F.floor(F.col("_c") / 2) + 1).select(*keys, floor_to(F.col("t"), 86400).alias("_m"))
    span = days * 86400
    start = middle.join(bounds, keys).select(*keys, F.greatest(F.col("_lo"), F.least(F.col("_m"), F.col("_hi") - span)).alias("_s"))
    points = start.select(*keys, F.explode(F.expr(f"sequence(_s, _s + {span - step}L, {step}L)")).alias("t"))
    return points.join(df, [*keys, "t"], "left")


def interpolation_audit(df: DataFrame, limit: int, keys: list[str] = KEYS) -> DataFrame:
    """Observed and filled counts of each series, and the filled share in percent. df is a complete grid."""
    done = fill_short_gaps(df, limit, keys)
    filled = F.sum(F.col("filled").cast("long"))
    kept = F.count("v")
    return done.groupBy(*keys).agg((kept - filled).alias("observed"), filled.alias("filled"), (100 * filled / kept).alias("pct_filled"))
