"""Bootstrap intervals from sufficient statistics.

What is resampled is first reduced to a few sums for each block, cluster or start; replicates then look draws up in those sums and
never touch rows again. Draws are hashes of (seed, replicate, slot), so reruns and other engines get the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import skill
from ..sources.tables import stored
from .blocked import numbered, running
from .grid import KEYS
from .ranks import ranged


#: Draws that are written out at once.
SLOTS = 4096
#: Places of a series that are held as arrays in one row, and draws that are made from a row of them.
HELD, CHUNK = 1 << 15, 1 << 17


def draw(seed: int, rep: Column, slot: Column, n: Column) -> Column:
    """A whole number from 0 to n - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), slot.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)


def draws(groups: DataFrame, n: str, reps: int, seed: int, keys: list[str], slots: Column | None = None, first: int = 0) -> DataFrame:
    """keys, rep, slot, place: n draws of n (or slots of n) for each replicate. groups: one row for each key with its n.

    Slots come in blocks, which are dealt over all tasks before they are written out as rows: no task has all draws of a key.
    """
    each = groups.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(first + reps - 1)))).withColumn("_m", slots if slots is not None else F.col(n))
    each = each.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_m") - 1) / SLOTS)))).repartition(*keys, "rep", "_b")
    last = F.least(F.col("_m"), (F.col("_b") + 1) * SLOTS) - 1
    each = each.withColumn("slot", F.explode(F.sequence(F.col("_b") * SLOTS, last.cast("bigint")))).drop("_b", "_m")
    return each.withColumn("place", draw(seed, F.col("rep"), F.col("slot"), F.col(n)))


def percentiles(reps: DataFrame, stat: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """ci_lo, ci_hi and the number of usable replicates."""
    a = (1 - level) / 2
    return reps.groupBy(*keys).agg(F.percentile(stat, a).alias("ci_lo"), F.percentile(stat, 1 - a).alias("ci_hi"), F.count(stat).alias("n_reps"))


def segment_blocks(scored: DataFrame, size: int, keys: list[str] = KEYS) -> DataFrame:
    """block: a dense number of runs of at most `size` scored rows that never pass a segment's end. scored has seg.

    Rows are numbered within their segments by blocks of time; a block is new at the first row of each run, and those are counted along
    the series in the same way.
    """
    placed = stored(numbered(scored, [*keys, "seg"]), "segment-rows")
    first = (F.col("_r") % size == 0).cast("bigint")
    counted = running(placed.withColumn("_new", first), {"_blocks": F.col("_new")}, keys)
    return counted.withColumn("block", (F.col("_blocks") - 1).cast("bigint")).drop("_r", "_c", "_new", "_blocks")


def bias_interval(arm_a: DataFrame, arm_c: DataFrame, blocks: DataFrame, reps: int, seed: int, keys: list[str] = KEYS, share: float = 0.5, redraws: int = 1) -> DataFrame:
    """Interval of skill_C - skill_A under one draw of blocks for both arms.

    arms: rows keyed by t with em2, ep2; blocks: the union of their rows with block. Replicates in which an arm has fewer than
    `share` of its rows are left out. With redraws over 1 up to redraws * reps are drawn and the first reps usable ones count;
    the interval is null where fewer than half of reps are usable (n_reps tells how many).
    """
    own = [*keys, "t"]
    rows = blocks.select(*own, "block")
    for arm, x in ((arm_a, "a"), (arm_c, "c")):
        rows = rows.join(arm.select(*own, F.col("em2").alias(f"m_{x}"), F.col("ep2").alias(f"p_{x}"), F.lit(1).alias(f"n_{x}")), own, "left")
    table = rows.groupBy(*keys, "block").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_a", "m_a", "p_a", "n_c", "m_c", "p_c")])
    return bias_of_blocks(table, reps, seed, keys, share, redraws)


def block_sums(rows: DataFrame, in_a: Column, in_c: Column, em2: str, ep2: str, keys: list[str] = KEYS, em2_a: str | None = None) -> DataFrame:
    """keys, block and for both arms n, m, p: counts and sums of squared errors, of rows that carry block, in one aggregate.

    em2_a: the squared errors of arm A's own model, where it has another than C's.
    """
    part = lambda c, f, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(f)
    one, m, p = F.lit(1), F.col(em2), F.col(ep2)
    return rows.groupBy(*keys, "block").agg(part(in_a, "n_a", one), part(in_a, "m_a", F.col(em2_a or em2)), part(in_a, "p_a", p), part(in_c, "n_c", one), part(in_c, "m_c", m), part(in_c, "p_c", p))


def bias_of_blocks(table: DataFrame, reps: int, seed: int, keys: list[str] = KEYS, share: float = 0.5, redraws: int = 1) -> DataFrame:
    """bias_interval from block_sums. Further draws are made only for series that lack usable replicates, reps at a time."""
    every = Window.partitionBy(*keys)
    names = [f"{x}_{arm}" for arm in "ac" for x in "nmp"]
    table = table.withColumn("block", (F.row_number().over(every.orderBy("block")) - 1).cast("bigint"))
    table = table.withColumns({"_n": F.count("*").over(every), "t_a": F.sum("n_a").over(every), "t_c": F.sum("n_c").over(every)})
    sums, facts = {x: F.sum(x) for x in names}, ["t_a", "t_c"]
    source = Drawn(table, "block", names, keys, facts)

    def replicates(first: int, only: DataFrame | None = None) -> DataFrame:
        rep = source.replicates(sums, reps, seed, first, only)
        rep = rep.where((F.col("n_a") >= share * F.col("t_a")) & (F.col("n_c") >= share * F.col("t_c")))
        bias = skill(F.col("m_c"), F.col("p_c")) - skill(F.col("m_a"), F.col("p_a"))
        return rep.select(*keys, "rep", bias.alias("bias"))

    if redraws == 1:
        return percentiles(replicates(0), "bias", keys)
    # where an arm has no error at all, no replicate has a bias
    open_, usable = source.rows.groupBy(*keys).agg(F.sum("p_a").alias("a"), F.sum("p_c").alias("c")).where("a > 0 and c > 0").select(*keys), None
    for wave in range(redraws):
        made = stored(replicates(wave * reps, open_).where("bias is not null"), "replicates")
        usable = made if usable is None else usable.unionByName(made)
        full = usable.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= reps).select(*keys)
        open_ = stored(open_.join(full, keys, "left_anti"), "lacking")
        if open_.isEmpty():
            break
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("rep"))
    got = percentiles(usable.withColumn("_nth", nth).where(F.col("_nth") <= reps), "bias", keys)
    enough = F.col("n_reps") >= reps / 2
    return got.withColumns({c: F.when(enough, F.col(c)) for c in ("ci_lo", "ci_hi")})


class Drawn:
    """What is drawn from, one row for each place (a dense number from 0) of a series, with _n, the series' number of places; written once.

    A series of up to HELD places is one row of arrays: a draw is looked up in its own row, and draws meet nothing else before they are
    summed. A longer series' draws meet its places by a shuffle, in which the places are the side that is held: draws are many
    times more, which estimates from the rows that they are made of don't show.
    """

    def __init__(self, rows: DataFrame, place: str, values: list[str], keys: list[str], facts: list[str] | None = None):
        self.keys, self.values, self.facts = keys, values, facts or []
        rows = rows.select(*keys, F.col(place).alias("place"), "_n", *values, *self.facts).dropna(subset=keys)
        self.rows = stored(rows, "places")
        cells = F.sort_array(F.collect_list(F.struct("place", *values)))
        held = self.rows.where(F.col("_n") <= HELD).groupBy(*keys, "_n", *self.facts).agg(cells.alias("_cells"))
        self.held = stored(held.select(*keys, "_n", *self.facts, *[F.col(f"_cells.{v}").alias(f"_{v}s") for v in values]), "held")
        self.long = self.rows.where(F.col("_n") > HELD)
        self.any_long = not self.long.isEmpty()

    def _long_groups(self) -> DataFrame:
        return self.long.groupBy(*self.keys).agg(F.max("_n").alias("_n"), *[F.max(f).alias(f) for f in self.facts])

    def _draws(self, reps: int, seed: int, slots: Column | None, first: int, only: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """Draws of held series, dealt by replicates, with the arrays; and of longer ones."""
        slots = F.col("_n") if slots is None else slots
        some = lambda df: df if only is None else df.join(only, self.keys, "left_semi")
        each = F.greatest(F.lit(1), F.floor(F.lit(CHUNK) / slots)).cast("int")
        tasks = int(self.held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = some(self.held).withColumns({"_slots": slots.cast("bigint"), "_each": each})
        held = held.withColumn("_from", F.explode(F.sequence(F.lit(first), F.lit(first + reps - 1), F.col("_each")))).repartition(tasks, *self.keys, "_from")
        held = held.withColumn("rep", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + F.col("_each") - 1, F.lit(first + reps - 1)))))
        held = held.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slots") - 1)))
        held = held.withColumn("place", draw(seed, F.col("rep"), F.col("slot"), F.col("_n")))
        return held, draws(some(self._long_groups()), "_n", reps, seed, self.keys, slots, first) if self.any_long else None

    def replicates(self, sums: dict[str, Column], reps: int, seed: int, first: int = 0, only: DataFrame | None = None) -> DataFrame:
        """keys, rep, facts and sums of the values of as many draws as there are places, for each of reps replicates from first on."""
        held, far = self._draws(reps, seed, None, first, only)
        held = held.withColumns({v: F.get(f"_{v}s", F.col("place").cast("int")) for v in self.values})
        far = None if far is None else far.join(self.long.select(*self.keys, "place", *self.values).hint("shuffle_hash"), [*self.keys, "place"])
        return self.summed(held, far, sums)

    def summed(self, held: DataFrame, far: DataFrame | None, sums: dict[str, Column]) -> DataFrame:
        facts = {f: F.first(f) for f in self.facts}
        out = lambda df, by: df.groupBy(*self.keys, *by, "rep").agg(*[c.alias(n) for n, c in (facts | sums).items()]).drop(*by)
        return out(held, ["_from"]) if far is None else out(held, ["_from"]).unionByName(out(far, []))


def circular_rmse_interval(scored: DataFrame, e2: Column, block: int, reps: int, seed: int, keys: list[str] = KEYS) -> DataFrame:
    """Interval of an RMSE by circular blocks in time order; the last block is cut so that each replicate has as many rows as the series.

    Sums over the block from every start come from running sums (by blocks of time), so a replicate adds up a few numbers.
    Squared errors must not be null.
    """
    d = running(scored.select(*keys, "t", e2.alias("_e")), {"_i": F.lit(1).cast("bigint"), "_c": F.col("_e")}, keys, totals={"_i": "_n"})
    d = stored(d.withColumns({"_i": F.col("_i") - 1, "_c": F.col("_c") - F.col("_e")}), "running-sums")
    whole = d.groupBy(*keys).agg(F.sum("_e").alias("all"))
    source = Drawn(d.join(whole, keys), "_i", ["_c"], keys, ["all"])
    b = F.when(F.col("_n") < 2 * block, F.greatest(F.lit(5), F.floor(F.col("_n") / 4))).otherwise(F.lit(block))
    slots = F.ceil(F.col("_n") / b)
    held, far = source._draws(reps, seed, slots, 0, None)
    end = F.col("place") + F.when(F.col("slot") == slots - 1, F.col("_n") - (slots - 1) * b).otherwise(b)
    stop = lambda df: df.withColumn("end", end).withColumn("stop", F.pmod(F.col("end"), F.col("_n")))
    held = stop(held).withColumns({"c0": F.get("__cs", F.col("place").cast("int")), "c1": F.get("__cs", F.col("stop").cast("int"))})
    if far is not None:
        before = source.long.select(*keys, "place", "_c")
        far = far.join(before.withColumnRenamed("_c", "c0").hint("shuffle_hash"), [*keys, "place"])
        far = stop(far).join(before.withColumnsRenamed({"place": "stop", "_c": "c1"}).hint("shuffle_hash"), [*keys, "stop"])
    wrapped = F.col("c1") - F.col("c0") + F.when(F.col("end") >= F.col("_n"), F.col("all")).otherwise(0.0)
    rep = source.summed(held, far, {"rmse": F.sqrt(F.sum(wrapped) / F.first("_n"))})
    return percentiles(rep, "rmse", keys)


def iid_mean_interval(df: DataFrame, value: str, reps: int, seed: int, keys: list[str]) -> DataFrame:
    """Interval of a mean by drawing values. Equal values are drawn by their place in a fixed order: values are dealt by ranges, and a place is
    the row's place in its range and the rows of the ranges before."""
    dealt, counts = ranged(df.select(*keys, F.col(value).alias("x")), "x", keys)
    own = [*keys, "_part"]
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*own).orderBy("x")) - 1)
    n = counts.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    rows = inside.join(counts.select(*own, "_off"), own).join(n, keys)
    rows = rows.withColumn("place", (F.col("_i") + F.col("_off")).cast("bigint"))
    return percentiles(Drawn(rows, "place", ["x"], keys).replicates({"mean": F.avg("x")}, reps, seed), "mean", keys)


def cluster_weights(clusters: DataFrame, reps: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """cluster, rep, weight: how often each cluster is drawn, over all or within strata. Shared by all statistics of one study."""
    strata = strata or []
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("cluster")) - 1
    listed = clusters.select(*strata, "cluster").distinct().withColumn("place", rank.cast("bigint"))
    n = listed.groupBy(*strata).agg(F.count("*").alias("n"))
    drawn = draws(n, "n", reps, seed, strata)
    joined = drawn.join(listed, [*strata, "place"])
    return joined.groupBy("cluster", "rep").agg(F.count("*").alias("weight"))


def weighed(sums: DataFrame, weights: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """sums with rep and weight, a row for each replicate that draws their cluster.

    few: the clusters don't grow with the table (days). Their weights, one row a cluster, are broadcast, and sums are dealt by keys before
    they meet them, so that replicates are summed and ordered where they were made and only sums are shuffled.
    """
    if not few:
        return sums.join(weights, "cluster")
    tasks = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = weights.groupBy("cluster").agg(F.collect_list(F.struct("rep", "weight")).alias("_drawn"))
    met = sums.repartition(tasks, *keys).join(F.broadcast(each), "cluster")
    return met.withColumn("_drawn", F.explode("_drawn")).select(*sums.columns, "_drawn.rep", "_drawn.weight")


def cluster_mean_interval(df: DataFrame, value: str, weights: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """Interval of a mean (ratio of sums) when whole clusters are drawn."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, "cluster").agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    rep = weighed(sums, weights, keys, few).groupBy(*keys, "rep").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("c") * F.col("weight"))).alias("mean"))
    return percentiles(rep, "mean", keys)


def paired_difference_interval(df: DataFrame, value: str, level: str, a: str, b: str, weights: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """Interval of mean(level a) - mean(level b) under the same draws."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, level, "cluster").agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    w = weighed(sums, weights, keys, few)
    part = lambda x: F.sum(F.when(F.col(level) == x, F.col("s") * F.col("weight"))) / F.sum(F.when(F.col(level) == x, F.col("c") * F.col("weight")))
    rep = w.groupBy(*keys, "rep").agg((part(a) - part(b)).alias("difference"))
    return percentiles(rep, "difference", keys)
