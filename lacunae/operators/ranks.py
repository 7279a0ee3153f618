"""Ranks and percentiles of long series: values are dealt by ranges, so a series is as many tasks as it needs.

Splitters are sampled by Spark; equal values never part. One row a range counts what lies before it. A range's rows are ordered by themselves; the
table is written once, so that ranges stay as they are for all that reads them. A range takes over from ranges before it for one
series only, so the offsets are fewer than the ranges and are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS
from ..sources.tables import stored


def ranged(df: DataFrame, value: str, keys: list[str] = KEYS, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """df (rows with a value) with _part, the range its row lies in, written; and keys, _part, _m (rows), _off (rows in the ranges before)."""
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.where(F.col(value).isNotNull()).repartitionByRange(n, *keys, value).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, counts.withColumn("_off", F.coalesce(F.sum("_m").over(before), F.lit(0)))


def _same(keys: list[str], other: str = "_o_"):
    """Whether keys equal the other columns of their names, null to null."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(other + k)) for k in keys], F.lit(True))


def average_ranks(df: DataFrame, value: str, name: str, keys: list[str] = KEYS, ties: str | None = None, tasks: int | None = None) -> DataFrame:
    """name: the rank of value from 1, ties sharing their mean; ties: how many rows share it. Rows without a value are left out."""
    dealt, counts = ranged(df, value, keys, tasks)
    own = [*keys, "_part"]
    inside = Window.partitionBy(*own)
    order = inside.orderBy(value)
    first, last = F.rank().over(order), F.round(F.cume_dist().over(order) * F.count("*").over(inside)).cast("bigint")
    got = dealt.withColumns({"_first": first, "_last": last})
    later = counts.where("_off > 0").select(*[F.col(k).alias(f"_o_{k}") for k in own], "_off")
    got = got.join(F.broadcast(later), _same(own), "left").withColumn(name, F.coalesce("_off", F.lit(0)) + (F.col("_first") + F.col("_last")) / 2)
    if ties:
        got = got.withColumn(ties, F.col("_last") - F.col("_first") + 1)
    return got.select(*df.columns, name, *([ties] if ties else []))


def percentiles(df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] = KEYS, tasks: int | None = None) -> DataFrame:
    """keys and one column for each name: the exact percentile at its share, between the two values next to it in order, in proportion.

    Counts tell which range holds a wanted place; only those ranges are ordered, and of each two values are picked.
    """
    dealt, counts = ranged(df.select(*keys, value), value, keys, tasks)
    total = counts.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    places = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("_n") - 1) * q).alias("at")) for n, q in wanted.items()]))
    asked = total.select(*keys, places.alias("_p")).select(*keys, F.col("_p.name").alias("_name"), F.col("_p.at").alias("_at"))
    asked = asked.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    held = counts.join(asked.withColumnsRenamed({k: f"_o_{k}" for k in keys}), _same(keys))
    held = held.where((F.col("_place") >= F.col("_off")) & (F.col("_place") < F.col("_off") + F.col("_m")))
    held = held.select(*[F.col(k).alias(f"_o_{k}") for k in (*keys, "_part")], "_name", "_at", "_place", "_off")
    own = [*keys, "_part"]
    same = _same(own)
    needed = dealt.join(held.select(*[f"_o_{k}" for k in own]).distinct(), same, "left_semi")
    placed = needed.withColumn("_i", F.row_number().over(Window.partitionBy(*own).orderBy(value)) - 1)
    picked = placed.join(held, same & (F.col("_i") + F.col("_off") == F.col("_place")))
    low, high, frac = F.min(value), F.max(value), F.first(F.col("_at") - F.floor("_at"))
    one = picked.groupBy(*keys, "_name").agg(((1 - frac) * low + frac * high).alias("_v"))
    return one.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in wanted])
