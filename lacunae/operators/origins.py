"""Forecast origins and splits: which rows may be forecast from, and which train and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_order
from .blocked import in_blocks, numbered, running, with_halo
from .features import with_target
from .grid import KEYS


def valid_origins(segmented: DataFrame, depth: int, seq_len: int, horizon: int, keys: list[str] = KEYS) -> DataFrame:
    """Rows with target whose features (depth rows back), input window (seq_len rows) and target lie in their own segment.

    Rows of blocked.placed are dealt by blocks of rows; others are numbered within their segments first.
    """
    if "_p" not in segmented.columns:
        rows = numbered(segmented, [*keys, "seg"])
        placed, place, size = rows, F.col("_r"), F.col("_c")
    else:
        rows, placed, place, size = segmented, segmented.withColumnsRenamed({"_r": "_rs", "_c": "_cs"}).withColumnsRenamed({"_p": "_r", "_n": "_c"}), F.col("_r"), F.col("_c")
    marked = with_target(with_halo(placed, 0, horizon), horizon, [*keys, "seg", "_blk"])
    kept = marked.where(F.col("_own") & (place >= max(depth, seq_len - 1)) & (size - place - 1 >= horizon))
    return kept.select(*[c for c in rows.columns if c in segmented.columns and c not in ("_r", "_c", "_p", "_n")], "target", "target_t")


def gap_aware_split(valid: DataFrame, seq_len: int, horizon: int, fraction: float = 0.75, least: int = 800, least_test: int = 300, keys: list[str] = KEYS) -> DataFrame:
    """split: train for the first part of valid rows, test after an embargo of seq_len + horizon valid rows, null between.

    Series with fewer than `least` valid or `least_test` test rows are left out.
    """
    cut = F.floor(F.col("_c") * fraction)
    start = cut + seq_len + horizon
    kept = numbered(valid, keys).where((F.col("_c") >= least) & (F.col("_c") - start >= least_test))
    return kept.withColumn("split", F.when(F.col("_r") < cut, "train").when(F.col("_r") >= start, "test")).drop("_r", "_c")


def both_splits(design: DataFrame, seq_len: int, horizon: int, fraction: float = 0.75, least: int = 800, least_test: int = 300, keys: list[str] = KEYS, embargo: int | None = None) -> DataFrame:
    """split_a (of valid rows, as gap_aware_split) and split_c (of all rows on the calendar of split_a, as calendar_split), in one frame.

    design: rows with target, target_t and valid. Series that fail the guards have neither. embargo: valid rows between train and test,
    seq_len + horizon unless given.
    """
    counted = running(design, {"_r": F.col("valid").cast("bigint")}, keys, totals={"_r": "_c"})
    cut = F.floor(F.col("_c") * fraction)
    start = cut + (seq_len + horizon if embargo is None else embargo)
    place = F.col("_r") - 1
    enough = F.col("valid") & (F.col("_c") >= least) & (F.col("_c") - start >= least_test)
    split = counted.withColumn("split_a", F.when(enough & (place < cut), "train").when(enough & (place >= start), "test")).drop("_r", "_c")
    bounds = bounds_of(split.withColumnRenamed("split_a", "split"), keys)
    out = in_blocks(split, bounds, keys, ["train_end", "test_start", "test_end"])
    train = (F.col("t") <= F.col("train_end")) & (F.col("target_t") < F.col("test_start"))
    return out.withColumn("split_c", F.when(train, "train").when(F.col("t").between(F.col("test_start"), F.col("test_end")), "test")).drop("train_end", "test_start", "test_end")


def bounds_of(split: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """train_end, test_start, test_end of each series."""
    when = lambda s: F.when(F.col("split") == s, F.col("t"))
    return split.groupBy(*keys).agg(F.max(when("train")).alias("train_end"), F.min(when("test")).alias("test_start"), F.max(when("test")).alias("test_end"))


def calendar_split(naive: DataFrame, bounds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """split of naive rows (with target) on another split's calendar; no training label reaches into the test window."""
    joined = naive.where("target is not null").join(bounds, keys)
    train = (F.col("t") <= F.col("train_end")) & (F.col("target_t") < F.col("test_start"))
    return joined.withColumn("split", F.when(train, "train").when(F.col("t").between(F.col("test_start"), F.col("test_end")), "test")).drop("train_end", "test_start", "test_end")


def uncovered(aware: DataFrame, naive: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Test rows of the gap-aware split that the aligned naive one lacks: must be none."""
    own = [*keys, "t"]
    return aware.where("split = 'test'").select(own).join(naive.where("split = 'test'").select(own), own, "left_anti")


def published_split(naive: DataFrame, fraction: float = 0.75, keys: list[str] = KEYS) -> DataFrame:
    """split of naive rows by place alone, without alignment or embargo."""
    return numbered(naive.where("target is not null"), keys).withColumn("split", F.when(F.col("_r") < F.floor(F.col("_c") * fraction), "train").otherwise("test")).drop("_r", "_c")


def window_drift(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Days between the starts and ends of two splits' test windows."""
    days = lambda x: ((F.col(f"b.{x}") - F.col(f"a.{x}")) / 86400).alias(f"drift_{x}")
    return bounds_of(a, keys).alias("a").join(bounds_of(b, keys).alias("b"), keys).select(*keys, days("test_start"), days("test_end"))


def origin_bounds(df: DataFrame, fractions: list[float], seq_len: int, horizon: int, share: float = 0.25, keys: list[str] = KEYS) -> DataFrame:
    """For each fraction: places and times of train end, test start and test end on a contiguous series."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    o = n.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("i_train", F.floor(F.col("fraction") * F.col("n")))
    o = o.withColumn("i_start", F.col("i_train") + seq_len + horizon)
    o = o.withColumn("i_end", F.least(F.col("n") - 1, F.col("i_start") + F.floor(F.col("n") * share)))
    times = numbered(df, keys).select(*keys, F.col("_r"), F.col("t"))
    for i, name in (("i_train", "train_end"), ("i_start", "test_start"), ("i_end", "test_end")):
        o = o.join(times.withColumnsRenamed({"_r": i, "t": name}), [*keys, i], "left")
    return o.select(*keys, "fraction", "n", "i_train", "i_start", "i_end", "train_end", "test_start", "test_end")


def origin_windows(df: DataFrame, overlapping: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Six origins: disjoint test blocks of a twelfth in the second half, or 20 % windows starting between 50 and 80 %."""
    o = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("origin", F.explode(F.sequence(F.lit(1), F.lit(6))))
    if overlapping:
        start = F.floor(F.col("n") * (0.5 + 0.06 * (F.col("origin") - 1)))
        end = F.least(F.col("n"), start + F.floor(F.col("n") * 0.2))
    else:
        block = F.floor(F.col("n") / 12)
        start = F.floor(F.col("n") / 2) + block * (F.col("origin") - 1)
        end = start + block
    return o.select(*keys, "origin", "n", start.alias("start"), end.alias("end"))


def walk_forward(df: DataFrame, blocks: int = 6, keys: list[str] = KEYS) -> DataFrame:
    """block of each row: that many equal blocks in order, the last with the remainder. Fold k tests block k, trains on those before."""
    return numbered(df, keys).withColumn("block", F.least(F.floor(F.col("_r") / F.greatest(F.lit(1), F.floor(F.col("_c") / blocks))), F.lit(blocks - 1))).drop("_r", "_c")


def fold_sizes(blocked: DataFrame, blocks: int = 6, keys: list[str] = KEYS) -> DataFrame:
    """fold, n_train, n_test of each fold."""
    n = blocked.groupBy(*keys, "block").agg(F.count("*").alias("n_test"))
    before = F.sum("n_test").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return n.withColumn("n_train", before).where("block > 0").select(*keys, F.col("block").alias("fold"), "n_train", "n_test")


def tuning_split(train: DataFrame, embargo: int, share: float = 0.2, keys: list[str] = KEYS) -> DataFrame:
    """part: the last share of the training rows validates, after an embargo."""
    start = F.floor(F.col("_c") * (1 - share))
    return numbered(train, keys).withColumn("part", F.when(F.col("_r") >= start, "validate").when(F.col("_r") < start - embargo, "fit")).drop("_r", "_c")


def at_least(df: DataFrame, counts: dict[str, tuple[Column, int]], keys: list[str] = KEYS) -> DataFrame:
    """Series that pass minimum counts: name -> (condition, least)."""
    passed = df.groupBy(*keys).agg(*[F.count(F.when(c, 1)).alias(n) for n, (c, _) in counts.items()])
    for n, (_, least) in counts.items():
        passed = passed.where(F.col(n) >= least)
    return passed
