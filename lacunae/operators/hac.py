"""Tests of forecast errors with autocorrelation-robust variances (Bartlett kernel): Diebold-Mariano and Clark-West.

The Bartlett kernel is a box convolved with itself, so its weighted sum of autocovariances is the sum of squares of moving sums of
lag + 1 values, those that overhang either end included. Moving sums are differences of running sums, whatever the lag. P-values come
from one call a result row.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS
from ..functions.special import normal_sf, t_two_sided
from ..sources.tables import stored
from .blocked import in_blocks, running
from .ranks import average_ranks


def truncation_lag(n: Column, h: int) -> Column:
    """Lag of the kernel: at least 10, the horizon less 1, and a rate in the number of rows; below the number of rows."""
    return F.least(n - 1, F.greatest(F.lit(10), F.lit(h - 1), F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("long")))


def hac_mean(df: DataFrame, value: Column, h: int, keys: list[str] = KEYS) -> DataFrame:
    """n, mean, variance of the mean (floor 1e-12) of a value in time order. Nulls are left out.

    Values and running sums are written once each, as both are read twice. With centred values c, running sums P and lag L, sum_k w_k c_t c_(t-k) = (sum_s (P_s - P_(s-L-1))^2 + sum of P_i^2 for the last L i < n) / (L+1).
    """
    d = stored(df.select(*keys, "t", value.alias("_x")).where("_x is not null"), "hac-values")
    stats = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mean")).withColumn("_l", truncation_lag(F.col("n"), h))
    d = in_blocks(d, stats, keys, ["n", "mean", "_l"])
    d = stored(running(d, {"_i": F.lit(1).cast("bigint"), "_p": F.col("_x") - F.col("mean")}, keys).drop("_x", "t"), "hac-sums")
    own = [*keys, "_i"]
    earlier = d.select(*keys, (F.col("_i") + F.col("_l") + 1).alias("_i"), F.col("_p").alias("_q"))
    moving = F.col("_p") - F.coalesce("_q", F.lit(0.0))
    over_end = F.when((F.col("_i") < F.col("n")) & (F.col("_i") >= F.col("n") - F.col("_l")), F.col("_p") * F.col("_p")).otherwise(0.0)
    sums = in_blocks(d, earlier, own, ["_q"], "left").groupBy(*keys, "n", "mean", "_l").agg(F.sum(moving * moving + over_end).alias("_s"))
    return sums.select(*keys, "n", "mean", F.greatest(F.lit(1e-12), F.col("_s") / (F.col("_l") + 1) / F.col("n") / F.col("n")).alias("variance"))


def diebold_mariano(df: DataFrame, e1: Column, e2: Column, h: int, keys: list[str] = KEYS) -> DataFrame:
    """Statistic (negative where the first errors are smaller) with the small-sample factor. Add p_values(..., 'dm')."""
    s = hac_mean(df, e1 * e1 - e2 * e2, h, keys)
    n = F.col("n")
    factor = F.sqrt(F.greatest(F.lit(1e-12), (n + 1 - 2 * h + h * (h - 1) / n) / n))
    return s.withColumn("dm", factor * F.col("mean") / F.sqrt("variance"))


def clark_west(df: DataFrame, y: Column, null: Column, alternative: Column, h: int, keys: list[str] = KEYS) -> DataFrame:
    """Statistic of the adjusted loss difference; large where the alternative adds to the null model."""
    adjusted = (y - null) * (y - null) - ((y - alternative) * (y - alternative) - (null - alternative) * (null - alternative))
    s = hac_mean(df, adjusted, h, keys)
    return s.withColumn("cw", F.col("mean") / F.sqrt("variance"))


#: How a statistic's p is found: two-sided t with n - 1 or n - 2 degrees of freedom, one- or two-sided normal.
KINDS = ("dm", "correlation", "greater", "two-sided")


def p_values(stats: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    """p of a statistic (with n beside it). One value a result row, so the function's cost doesn't matter.

    kind: dm (two-sided t), correlation (of r, by t = r sqrt((n-2)/(1-r^2))), greater or two-sided (normal). By default dm for a column
    of that name, else greater.
    """
    kind = kind or ("dm" if column == "dm" else "greater")
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")

    @F.pandas_udf("double")
    def p(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_of(a, b, kind) for a, b in zip(x, n, strict=True)])

    return stats.withColumn("p", p(F.col(column), F.col("n")))


def p_of(x: float, n: float, kind: str) -> float | None:
    if pd.isna(x) or (kind == "correlation" and n < 3):
        return None
    if kind == "dm":
        return t_two_sided(x, n - 1)
    if kind == "correlation":
        return 0.0 if abs(x) >= 1 else t_two_sided(x * math.sqrt((n - 2) / (1 - x * x)), n - 2)
    return normal_sf(x) if kind == "greater" else min(1.0, 2 * normal_sf(abs(x)))


def mann_whitney(df: DataFrame, group: Column, value: str, keys: list[str] = KEYS, two_sided: bool = False) -> DataFrame:
    """u of the rows where group holds, and z: the normal approximation with tie and continuity correction.

    The alternative is greater; two_sided: z of the larger of the two groups' u, for p_values(..., 'two-sided').
    """
    d = average_ranks(df.select(*keys, value, group.alias("_g")), value, "_r", keys, "_t")
    n, n1 = F.count("*"), F.count(F.when(F.col("_g"), 1))
    s = d.groupBy(*keys).agg(n.alias("n"), n1.alias("n1"), F.sum(F.when(F.col("_g"), F.col("_r"))).alias("_s"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    s = s.withColumn("n2", F.col("n") - F.col("n1")).withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2)
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((F.col("n") + 1) - F.col("_ties") / (F.col("n") * (F.col("n") - 1))))
    off = F.col("u") - F.col("n1") * F.col("n2") / 2
    return s.withColumn("z", F.when(spread > 0, ((F.abs(off) if two_sided else off) - 0.5) / spread)).drop("_s", "_ties")


def holm(tests: DataFrame, p: str, name: str, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """supported: whether the test passes Holm's step-down procedure within its family."""
    family = Window.partitionBy(*(by or []))
    order = family.orderBy(p, name)
    step = F.row_number().over(order)
    ok = (F.col(p) <= alpha / (F.count("*").over(family) - step + 1)).cast("int")
    return tests.withColumn("_ok", ok).withColumn("supported", F.min("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def spearman(df: DataFrame, x: str, y: str, keys: list[str] = KEYS, few: bool = False) -> DataFrame:
    """few: groups don't grow with the table (runs of a record, as many as the parameters say), so a group is ranked by one window."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    if few:
        rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
        d = d.withColumns({"_rx": rank(x), "_ry": rank(y)})
    else:
        d = average_ranks(average_ranks(d, x, "_rx", keys), y, "_ry", keys)
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def pearson(df: DataFrame, x: Column, y: Column, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(x + y).alias("n"), F.corr(x, y).alias("r"))


def log_correlation(df: DataFrame, x: str, y: str, keys: list[str] = KEYS, floor: float = 1e-4) -> DataFrame:
    ln = lambda c: F.ln(F.greatest(F.col(c), F.lit(floor)))
    return pearson(df, ln(x), ln(y), keys)
