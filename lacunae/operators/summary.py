"""Algebra of result tables: cells, pivots, monotonicity, survival, reliability, bins, seeds, long-form numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_quantile

CONDITIONS = ("MANY-SHORT", "MEDIUM", "FEW-LONG")


def cell_means(df: DataFrame, value: str, cell: list[str], across: str = "condition", columns: tuple = CONDITIONS, least: int = 3) -> DataFrame:
    """One row a cell, a column for each condition: the mean of at least `least` values, else null."""
    means = df.groupBy(*cell, across).agg(F.when(F.count(value) >= least, F.avg(value)).alias("m"))
    return means.groupBy(*cell).pivot(across, list(columns)).agg(F.first("m"))


def complete_cells(cells: DataFrame, columns: tuple = CONDITIONS) -> DataFrame:
    return cells.dropna(subset=list(columns))


def monotonic(cells: DataFrame, by: list[str], columns: tuple = CONDITIONS) -> DataFrame:
    """How many complete cells fall from the first condition to the last."""
    falls = None
    for a, b in zip(columns, columns[1:]):
        step = F.col(f"`{a}`") >= F.col(f"`{b}`")
        falls = step if falls is None else falls & step
    return complete_cells(cells, columns).groupBy(*by).agg(F.count(F.when(falls, 1)).alias("n_monotonic"), F.count("*").alias("n_cells"))


def survival(df: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that survived in every cell of a grid, zeros included."""
    return grid.join(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reliable(skill: Column, ratio: Column, least_skill: float = -50.0, low: float = 0.7, high: float = 1.4) -> Column:
    """Whether a run's own skill and persistence ratio are within reason."""
    return (skill > least_skill) & ratio.between(low, high)


def right_closed_bins(x: Column, edges: list[float]) -> Column:
    """Number of the bin (edge, next edge] that holds x; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[k]) & (x <= edges[k + 1]), k).otherwise(out)
    return out


def binned(df: DataFrame, x: str, y: str, edges: list[float]) -> DataFrame:
    """n, median and quartiles of y in each bin of x that has any."""
    q = lambda p: F.percentile(y, p)
    return df.withColumn("bin", right_closed_bins(F.col(x), edges)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def pooled(df: DataFrame, value: str, sets: list[list[str]]) -> DataFrame:
    """n, mean, median over several groupings in one pass; a column is null where its grouping leaves it out."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def sign(x: Column, tolerance: float = 0.005) -> Column:
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)


def sign_agreement(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Whether all rows of a group have one sign."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.countDistinct(sign(F.col(value))) == 1).alias("agree"))


def origin_summary(df: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """Mean, sd, t interval by each group's own number of values, one sign over origins, and whether the interval leaves out 0."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return n.map(lambda x: t_quantile((1 + level) / 2, x - 1) if x > 1 else None).astype(float)

    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.countDistinct(sign(F.col(value))) == 1).alias("one_sign"))
    half = quantile("n") * F.col("sd") / F.sqrt("n")
    out = out.withColumn("_h", half).select(*by, "n", "mean", "sd", (F.col("mean") - F.col("_h")).alias("ci_lo"), (F.col("mean") + F.col("_h")).alias("ci_hi"), "one_sign")
    return out.withColumn("excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Over seeds or a parameter grid: extremes, mean, sd, one sign."""
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.countDistinct(sign(F.col(value))) == 1).alias("one_sign"))


def best_of(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """The row with the least value in each group, the first in order among equal ones."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(value, *order))
    return df.withColumn("_n", nth).where("_n = 1").drop("_n")


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each number: keys, stat, value."""
    pairs = F.array(*[F.struct(F.lit(v).alias("stat"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.stat", "p.value")


def excluding_zero(intervals: DataFrame, by: list[str]) -> DataFrame:
    """How many intervals leave out 0."""
    out = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    return intervals.groupBy(*by).agg(F.count(F.when(out, 1)).alias("n_excluding"), F.count("*").alias("n"))


def widest_change(intervals: DataFrame, by: list[str], size: str = "block") -> DataFrame:
    """Largest relative change of interval width between block sizes, in percent."""
    w = F.col("ci_hi") - F.col("ci_lo")
    return intervals.groupBy(*by).agg((100 * (F.max(w) / F.min(w) - 1)).alias("width_change"))


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(keys).intersect(b.select(keys))


def reliable_share(df: DataFrame, value: str, most: float, by: str = "condition") -> DataFrame:
    """n and share of the rows of each group whose value lies within `most` of 0."""
    small = F.abs(F.col(value)) <= most
    return df.groupBy(by).agg(F.count(F.when(small, 1)).alias("n"), F.avg(small.cast("double")).alias("share"))


def collate(tables: dict[str, DataFrame | None], key: str, wanted: dict[str, list[str]], spark) -> DataFrame:
    """table, key, stat, value: the wanted numbers of many tables. A table that is None gives one row with the stat `missing`."""
    out = None
    for name, df in tables.items():
        rows = spark.createDataFrame([(None, "missing", None)], f"{key} string, stat string, value double") if df is None else long_form(df, [key], wanted[name])
        rows = rows.select(F.lit(name).alias("table"), key, "stat", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
