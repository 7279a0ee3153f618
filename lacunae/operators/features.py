"""Features and targets, within segments (gap-aware: pass the segment among the keys) or by row position (naive).

All features of one call share one window specification, so Spark sorts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, full, hour_of, in_order, last_rows, so_far
from .blocked import numbered, with_halo

DEPTH = 60
LAGS = (1, 2, 3, 5, 10, 30, 60)
ROLLS = (5, 15, 60)


def lags_up_to(depth: int) -> list[int]:
    """The lags of a feature depth: the standard ones within it, and the depth itself."""
    return sorted({k for k in LAGS if k <= depth} | {depth})


def feature_columns(depth: int, keys: list[str]) -> dict[str, Column]:
    """All features but the Kalman level, by name, within groups of keys."""
    order, v = in_order(keys), F.col("v")
    out: dict[str, Column] = {"lag_0": v}
    out |= {f"lag_{k}": F.lag("v", k).over(order) for k in lags_up_to(depth)}
    for w in (w for w in ROLLS if w <= depth):
        over = last_rows(keys, w)
        out[f"roll_mean_{w}"] = full(F.avg("v").over(over), over, w, v)
        out[f"roll_std_{w}"] = full(F.stddev_samp("v").over(over), over, w, v)
    out["shear"] = v - F.lag("v", 1).over(order)
    n = min(30, depth)
    over = last_rows(keys, n)
    out["turbulence"] = full(F.stddev_samp("v").over(over) / (F.avg("v").over(over) + 1e-9), over, n, v)
    angle = hour_of(F.col("t")) * F.lit(2 * math.pi / 24)
    return out | {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}


def build_features(df: DataFrame, depth: int = DEPTH, keys: list[str] = KEYS, kalman: bool = True) -> DataFrame:
    """lag_0, lags, rolling means and deviations (null until full), first difference, turbulence, Kalman level, hour of day.

    Groups of keys are numbered by blocks of time and dealt by blocks of rows with a halo, so a long group isn't one task.
    """
    back, rows = kalman_reach()
    own = [*keys, "_blk"]
    halo = with_halo(numbered(df, keys), max(depth, back), 0, rows)
    made = halo.select("*", *[c.alias(k) for k, c in feature_columns(depth, own).items()])
    made = kalman_in_blocks(made, own, "_r", "kalman") if kalman else made
    return made.where("_own").drop("_r", "_c", "_blk", "_own")


def feature_names(depth: int = DEPTH, kalman: bool = True) -> list[str]:
    rolls = [w for w in ROLLS if w <= depth]
    names = ["lag_0", *(f"lag_{k}" for k in lags_up_to(depth)), *(f"roll_{x}_{w}" for w in rolls for x in ("mean", "std")), "shear", "turbulence", "hour_sin", "hour_cos"]
    return names + ["kalman"] * kalman


def kalman_gains(q: float = 0.02, r: float = 0.6, most: int = 4096) -> list[float]:
    """Gains of the scalar filter by place, until they stay as they are: they depend on the place only. The first row is its own level."""
    p, out = 1.0, [1.0]
    while len(out) < 3 or (out[-1] != out[-2] and len(out) < most):
        m = p + q
        out.append(m / (m + r))
        p = (1 - out[-1]) * m
    return out


def kalman_reach(q: float = 0.02, r: float = 0.6) -> tuple[int, int]:
    """Rows back beyond which a level remembers less than a double can hold, and rows that a block may have at the most."""
    rate = -math.log1p(-kalman_gains(q, r)[-1])
    back = math.ceil(50 / rate)
    return back, max(1, math.floor(500 / rate) - back)


def kalman_level(df: DataFrame, keys: list[str] = KEYS, q: float = 0.02, r: float = 0.6) -> DataFrame:
    """kalman: the causal scalar filter's level, started afresh for each group of keys.

    The recursion as it stands, bit for bit: rows are dealt by keys, sorted by Spark, and streamed in Arrow batches; only the
    filter's state is kept, never the group. kalman_level_blocked is the form for long series.
    """
    schema = df.schema.add("kalman", "double")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x, p = None, 0.0, 1.0
        for part in parts:
            level = []
            for own, z in zip(zip(*(part[k] for k in keys), strict=True), part["v"].tolist(), strict=True):
                if own != key:
                    key, x, p = own, z, 1.0
                else:
                    m = p + q
                    k = m / (m + r)
                    x = x + k * (z - x)
                    p = (1 - k) * m
                level.append(x)
            yield part.assign(kalman=level)

    return df.repartition(*keys).sortWithinPartitions(*keys, "t").mapInPandas(run, schema)


def kalman_level_blocked(df: DataFrame, keys: list[str] = KEYS, q: float = 0.02, r: float = 0.6) -> DataFrame:
    """kalman_level to within rounding, by blocks of rows of each group: a level forgets what lies further back than a halo of some hundred rows."""
    back, rows = kalman_reach(q, r)
    halo = kalman_in_blocks(with_halo(numbered(df, keys), back, 0, rows), [*keys, "_blk"], "_r", "kalman", q, r)
    return halo.where("_own").drop("_r", "_c", "_blk", "_own")


def kalman_in_blocks(halo: DataFrame, own: list[str], place: str, name: str, q: float = 0.02, r: float = 0.6) -> DataFrame:
    """name: the level within groups of own, blocks of at most kalman_reach() rows; place: a row's place (from 0) in its whole group.

    The recursion x = (1 - k) x + k v is linear and its gains are known by place, so within a block the level is one running sum:
    with L the running sum of ln(1 - k), x = exp(L) (v of the first row + sum of k v exp(-L)).
    """
    gains = kalman_gains(q, r)
    over, to_here = in_order(own), so_far(own)
    gain = F.coalesce(F.get(F.array(*map(F.lit, gains)), F.col(place).cast("int")), F.lit(gains[-1]))
    out = halo.withColumn("_gain", gain).withColumn("_first", F.row_number().over(over) == 1)
    out = out.withColumn("_log", F.sum(F.when(F.col("_first"), 0.0).otherwise(F.log1p(-F.col("_gain")))).over(to_here))
    part = F.when(F.col("_first"), F.col("v")).otherwise(F.col("_gain") * F.col("v") * F.exp(-F.col("_log")))
    return out.withColumn(name, F.exp("_log") * F.sum(part).over(to_here)).drop("_gain", "_first", "_log")


def both_designs(segmented: DataFrame, depth: int, seq_len: int, horizon: int, keys: list[str] = KEYS) -> DataFrame:
    """Rows with target (by row position), target_t, valid (features, input window and target within the row's own segment), and all
    features twice: within segments (a_...) and by row position (n_...).

    Rows are numbered by blocks of time (unless they are blocked.placed already) and dealt once more, with a halo that reaches as far as
    any feature or target; all windows of both designs share that one exchange.
    """
    seg = [*keys, "seg"]
    if "_p" not in segmented.columns:
        segmented = numbered(numbered(segmented, seg).withColumnsRenamed({"_r": "_p", "_c": "_n"}), keys)
    back, rows = kalman_reach()
    halo = with_halo(segmented, max(depth, back), horizon, rows)
    naive, aware = [*keys, "_blk"], [*seg, "_blk"]
    out = with_target(halo, horizon, naive)
    for own, mark, place in ((naive, "n_", "_r"), (aware, "a_", "_p")):
        out = out.select("*", *[c.alias(mark + n) for n, c in feature_columns(depth, own).items()])
        out = kalman_in_blocks(out, own, place, mark + "kalman")
    ok = (F.col("_p") >= max(depth, seq_len - 1)) & (F.col("_n") - F.col("_p") - 1 >= horizon)
    return out.where(F.col("_own") & F.col("target").isNotNull()).withColumn("valid", ok).drop("_p", "_n", "_r", "_c", "_blk", "_own")


def with_target(df: DataFrame, horizon: int, keys: list[str] = KEYS) -> DataFrame:
    """target and target_t: value and time of the row `horizon` rows ahead in the group of keys."""
    order = in_order(keys)
    return df.withColumn("target", F.lead("v", horizon).over(order)).withColumn("target_t", F.lead("t", horizon).over(order))


def displaced(horizon: int, step: int) -> Column:
    """Whether the target lies further ahead than the horizon, because a gap is between."""
    return F.col("target_t") - F.col("t") > horizon * step


def sequences(df: DataFrame, length: int, keys: list[str] = KEYS) -> DataFrame:
    """window: the last `length` values in order, null until there are so many."""
    over = last_rows(keys, length)
    return df.withColumn("window", F.when(F.count("v").over(over) == length, F.collect_list("v").over(over)))


def feature_differences(naive: DataFrame, aware: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """One row: for each feature the largest absolute difference on common rows, and on how many rows any exceeds 1e-9."""
    a = aware.select(*keys, "t", *[F.col(n).alias(f"_{n}") for n in names]).dropna()
    both = naive.join(a, [*keys, "t"])
    gap = {n: F.abs(F.col(n) - F.col(f"_{n}")) for n in names}
    return both.agg(*[F.max(g).alias(f"max_{n}") for n, g in gap.items()], F.count(F.when(F.greatest(*gap.values()) > 1e-9, 1)).alias("n_differ"), F.count("*").alias("n_rows"))


def check_instants(segmented: DataFrame, places: int = 5, starts: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """keys, cut: times at which to check a series' features: places spread over it, and its first segments' starts."""
    placed = numbered(segmented, keys)
    first = F.min("t").over(Window.partitionBy(*keys, "seg")) == F.col("t")
    spread = F.array(*[F.floor(k * F.col("_c") / (places + 1)) for k in range(1, places + 1)])
    return placed.withColumn("_first", first).where(F.array_contains(spread, F.col("_r")) | (F.col("_first") & (F.col("seg") < starts))).select(*keys, F.col("t").alias("cut")).distinct()


def causality_checks(segmented: DataFrame, build, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """keys, cut, wrong: for each of check_instants, whether any feature there changes (beyond 1e-9, or in being null) when all later
    rows are taken away. build(df, keys) makes the features within groups of keys."""
    cuts = check_instants(segmented, keys=keys)
    own = [*keys, "cut"]
    whole = build(segmented, [*keys, "seg"]).join(cuts.withColumn("t", F.col("cut")), [*keys, "t"]).select(*own, *names)
    prefix = segmented.join(cuts, keys).where("t <= cut")
    short = build(prefix, [*own, "seg"]).where("t = cut").select(*own, *[F.col(n).alias(f"_{n}") for n in names])
    wrong = [F.col(n).isNull() != F.col(f"_{n}").isNull() for n in names] + [F.coalesce(F.abs(F.col(n) - F.col(f"_{n}")) > 1e-9, F.lit(False)) for n in names]
    any_wrong = wrong[0]
    for w in wrong[1:]:
        any_wrong = any_wrong | w
    return whole.join(short, own).select(*own, any_wrong.alias("wrong"))
