"""Plans for series too long for one task.

Rows are dealt by blocks of time, and one row a block is all that is ordered along a whole series; or, once rows are numbered, by
blocks of rows with copies of their neighbours' edges (a halo), within which any window of bounded reach gives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, in_order, so_far

#: Seconds of a block of time, and rows of a block of rows.
SPAN, ROWS = 1 << 20, 1 << 14


def _along(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_k")


def _back(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("_k"))


#: All rows of an ordered window before the current one. What follows a row is what stands before it in the opposite order, so no frame
#: reaches to UNBOUNDED FOLLOWING, which Spark would evaluate anew for every row.
_EARLIER = (Window.unboundedPreceding, -1)


def in_blocks(rows: DataFrame, per_block: DataFrame, own: list[str], keep: list[str], how: str = "inner") -> DataFrame:
    """Each row with what its block (or series) has; null keys are keys like others."""
    other = per_block.select(*[F.col(k).alias(f"_o_{k}") for k in own], *keep)
    same = F.lit(True)
    for k in own:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return rows.join(other, same, how).drop(*[f"_o_{k}" for k in own])


def running(df: DataFrame, sums: dict[str, Column], keys: list[str] = KEYS, span: int = SPAN, totals: dict[str, str] | None = None) -> DataFrame:
    """Named sums of columns (never null) over the rows up to each one in time order. totals: names for the whole series' sums."""
    own, names = [*keys, "_k"], list(sums)
    dealt = df.withColumns({"_k": F.floor(F.col("t") / span)} | {f"_x_{n}": c for n, c in sums.items()})
    inside = dealt.withColumns({f"_in_{n}": F.sum(f"_x_{n}").over(so_far(own)) for n in names})
    each = dealt.groupBy(*own).agg(*[F.sum(f"_x_{n}").alias(f"_b_{n}") for n in names])
    before = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    kept = {f"_off_{n}": F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)) for n in names}
    kept |= {total: F.sum(f"_b_{n}").over(Window.partitionBy(*keys)) for n, total in (totals or {}).items()}
    got = in_blocks(inside, each.withColumns(kept), own, list(kept))
    return got.withColumns({n: F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in names}).drop("_k", *[f"{x}{n}" for n in names for x in ("_x_", "_in_", "_off_")])


def numbered(df: DataFrame, keys: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """_r: place from 0, _c: rows of the series."""
    return running(df, {"_r": F.lit(1).cast("bigint")}, keys, span, {"_r": "_c"}).withColumn("_r", F.col("_r") - 1)


def with_halo(placed: DataFrame, back: int, ahead: int, rows: int = ROWS) -> DataFrame:
    """placed (with _r and _c) dealt to blocks of rows: _blk, and _own, false on copies of up to `back` rows before a block and `ahead` after it.

    Compute windows of that reach with _blk among the keys, then keep the rows where _own holds.
    """
    first = F.floor(F.greatest(F.lit(0), F.col("_r") - ahead) / rows)
    last = F.floor(F.least(F.col("_c") - 1, F.col("_r") + back) / rows)
    return placed.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_blk") == F.floor(F.col("_r") / rows))


def nearest(df: DataFrame, value: str, keys: list[str] = KEYS, span: int = SPAN, first: list[Column] | None = None) -> DataFrame:
    """_before and _after: the last and next value that is not null, in the order of t, the row's own included.

    Within a block of time two running passes, one in either direction, hand them on; beyond its edges one row a block (its first
    and last value) does, carried along the series in the same two ways. first: what goes first of rows with equal times, in both directions.
    """
    own = [*keys, "_k"]
    dealt = df.withColumn("_k", F.floor(F.col("t") / span))
    ties = first or []
    up, down = Window.partitionBy(*own).orderBy("t", *ties), Window.partitionBy(*own).orderBy(F.desc("t"), *ties)
    here = (Window.unboundedPreceding, 0)
    inside = dealt.withColumns({"_u": F.last(value, True).over(up.rowsBetween(*here)), "_d": F.last(value, True).over(down.rowsBetween(*here))})
    known = dealt.where(F.col(value).isNotNull())
    edges = known.groupBy(*own).agg(F.max_by(value, "t").alias("_l"), F.min_by(value, "t").alias("_f")).unionByName(dealt.select(*own).distinct(), allowMissingColumns=True)
    edges = edges.groupBy(*own).agg(F.max("_l").alias("_l"), F.max("_f").alias("_f"))
    edges = edges.withColumns({"_eu": F.last("_l", True).over(_along(keys).rowsBetween(*_EARLIER)), "_ed": F.last("_f", True).over(_back(keys).rowsBetween(*_EARLIER))})
    got = in_blocks(inside, edges, own, ["_eu", "_ed"])
    return got.withColumns({"_before": F.coalesce("_u", "_eu"), "_after": F.coalesce("_d", "_ed")}).drop("_k", "_u", "_d", "_eu", "_ed")


def placed(df: DataFrame, step: int, keys: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """Everything that numbers rows, in one pass: seg (segment_ids), _r and _c (place from 0 in the series, its rows), _p and _n (place from
    0 in the segment, its rows).

    Rows meet by block of time once; one edge row a block has its rows, its breaks, its first and last time and the sizes of its first and
    last piece, and only edges are ordered along a series. A segment's first row comes from the last block before in which one began, its last
    row from the next block in which it ends.
    """
    own = [*keys, "_k"]
    dealt = df.withColumn("_k", F.floor(F.col("t") / span))
    order = in_order(own)
    dealt = dealt.withColumns({"_i": F.row_number().over(order) - 1, "_x": F.coalesce((F.col("t") - F.lag("t").over(order) != step).cast("long"), F.lit(0))})
    dealt = dealt.withColumn("_b", F.sum("_x").over(so_far(own)))
    piece = Window.partitionBy(*own, "_b")
    dealt = dealt.withColumns({"_j": F.row_number().over(piece.orderBy("t")) - 1, "_s": F.count("*").over(piece)})
    edges = dealt.groupBy(*own).agg(
        F.count("*").alias("_m"), F.max("_b").alias("_nb"), F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.max(F.when(F.col("_b") == 0, F.col("_s"))).alias("_s0"), F.max_by("_s", "t").alias("_s1")
    )
    along, back, whole = _along(keys), _back(keys), Window.partitionBy(*keys)
    joint = F.coalesce((F.col("_t0") - F.lag("_t1").over(along) != step), F.lit(False))
    edges = edges.withColumns({"_cut": joint, "_off": F.coalesce(F.sum("_m").over(along.rowsBetween(*_EARLIER)), F.lit(0)), "_c": F.sum("_m").over(whole)})
    seg_off = F.coalesce(F.sum("_nb").over(along.rowsBetween(*_EARLIER)), F.lit(0)) + F.sum(F.col("_cut").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.withColumns({
        "_sg": seg_off,
        # the first row of the last segment that begins in the block, and the last row of the one that reaches into it, if it ends there
        "_begun": F.when(F.col("_cut") | (F.col("_nb") > 0) | (F.col("_off") == 0), F.when(F.col("_nb") > 0, F.col("_off") + F.col("_m") - F.col("_s1")).otherwise(F.col("_off"))),
        "_ended": F.when(F.col("_cut"), F.col("_off") - 1).when(F.col("_nb") > 0, F.col("_off") + F.col("_s0") - 1),
    })
    edges = edges.withColumns({"_start": F.when(F.col("_cut") | (F.col("_off") == 0), F.col("_off")).otherwise(F.last("_begun", True).over(along.rowsBetween(*_EARLIER)))})
    edges = edges.withColumn("_end", F.coalesce(F.last("_ended", True).over(back.rowsBetween(*_EARLIER)), F.col("_c") - 1))
    got = in_blocks(dealt, edges, own, ["_off", "_c", "_sg", "_start", "_end", "_nb"])
    row = F.col("_off") + F.col("_i")
    begin = F.when(F.col("_b") == 0, F.col("_start")).otherwise(row - F.col("_j"))
    end = F.when(F.col("_b") == F.col("_nb"), F.col("_end")).otherwise(row - F.col("_j") + F.col("_s") - 1)
    out = got.withColumns({"seg": F.col("_b") + F.col("_sg"), "_r": row, "_p": row - begin, "_n": end - begin + 1})
    return out.select(*df.columns, "seg", "_r", "_c", "_p", "_n")
