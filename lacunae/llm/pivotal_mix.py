"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should appear target / source_size times: some whole copies and a fractional one with probability
p. Rounding the fractions independently would leave the source's word count to chance. Here two documents are paired and
probability mass, measured in words, moves from one to the other at random until one's fraction is 0 or 1; the other meets the
next document. Expectations and the source's total are kept at each step. Groups of documents of one source are rounded in
parallel; each leaves one open residual, and the residuals meet again in groups on the next level of a reduction tree, until
one is left for each source. The words taken from a source so differ from its target by less than the last document's size.

Random numbers are hashes of seed, level and a row's key (doc_id, text hash, and its number among rows that repeat both), so
reruns agree, and rows of one id, or without an id, are dealt to groups like any others; one hash sorts a group and another
decides its transfers, so that a transfer is random given the pair. Null sources are a source of their own, last in order.
Null and empty texts have no words and are never in doubt. Repeated rows are counted first, then numbered in blocks, and rounded
each on its own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashable, partitions, stored, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
GROUP = 128
#: Repeats of one row that are numbered at once.
REPEATS = 4096


def with_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (the number of runs of characters other than ASCII blanks), h (a hash of the text)."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("bigint").alias("size"), F.xxhash64(text_col).alias("h"))


def numbered_repeats(sizes: DataFrame) -> DataFrame:
    """sizes with h made a key of the row: equal rows are counted (copies meet before the shuffle) and numbered.

    Numbers come in blocks, which are dealt anew before they are written out as rows, so that a row repeated very often isn't one task's.
    """
    names = sizes.columns
    counted = sizes.groupBy(*names).agg(F.count("*").alias("_m"))
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_m") - 1) / REPEATS))))
    blocks = blocks.repartition(partitions(sizes.sparkSession), F.xxhash64("doc_id", "h", "_b"))
    last = F.least(F.col("_m"), (F.col("_b") + 1) * REPEATS) - 1
    rows = blocks.withColumn("_k", F.explode(F.sequence(F.col("_b") * REPEATS, last)))
    return rows.withColumn("h", F.xxhash64("h", "_k")).select(names)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: one row a source.

    Sources in order of their names get the weights in turn. A target is level * weight, at most `most` times the source's
    size; the level is what shares out the rest. Going up by size / weight, the first source that the level of those not yet
    full doesn't fill fixes it. The windows run over one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    return t.select("source", "source_size", "n_docs", F.least("cap", level * F.col("weight")).alias("target"))


def move(p: float, s: float, q: float, r: float, u: float) -> tuple[float, float]:
    """Fractions of two documents with p, q and sizes s, r after mass has moved; u in [0, 1) decides which way."""
    gain, lose = min((1 - p) * s, q * r), min(p * s, (1 - q) * r)
    if u * (gain + lose) < lose:
        return (1.0, max(0.0, q - (1 - p) * s / r)) if (1 - p) * s <= q * r else (p + q * r / s, 0.0)
    return (0.0, min(1.0, q + p * s / r)) if p * s <= (1 - q) * r else (p - (1 - q) * r / s, 1.0)


def round_group(ps: list[float], sizes: list[float], us: list[float]) -> tuple[list[float], int]:
    """Fractions after rounding one group in turn, and the place of the one still open (-1: none)."""
    ps, open_ = list(ps), -1
    for k in range(len(ps)):
        if 0 < ps[k] < 1:
            if open_ < 0:
                open_ = k
                continue
            ps[open_], ps[k] = move(ps[open_], sizes[open_], ps[k], sizes[k], us[k])
            open_ = next((x for x in (open_, k) if 1e-9 < ps[x] < 1 - 1e-9), -1)
    return [float(round(p)) if k != open_ else p for k, p in enumerate(ps)], open_


_UNIT = "doc_id {id}, source string, size bigint, h bigint, source_size bigint, target double, whole bigint, p double, part bigint, turn bigint, u double, open boolean"


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 1, group: int = GROUP, **columns) -> DataFrame:
    """doc_id, source, size, h, source_size, target, copies, taken: how often each document enters the mix, and its words there. h is a hash
    of the text and of the row's number among its repeats (numbered_repeats)."""
    sizes = stored(numbered_repeats(with_sizes(docs, **columns)), "mix-sizes")
    table = stored(targets(sizes, weights, share, most), "mix-targets")
    schema = _UNIT.format(id=sizes.schema["doc_id"].dataType.simpleString())
    t = table.select(F.col("source").alias("_s"), "source_size", "target", F.ceil(F.col("n_docs") / group).alias("parts"))
    unit = sizes.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    unit = unit.withColumn("whole", F.floor(rate)).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    unit = unit.withColumn("part", F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.col("parts"))).drop("parts")
    names = [x.split()[0] for x in schema.split(", ")]

    def drawn(df: DataFrame, level: int) -> DataFrame:
        u = F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit(seed), F.lit(level), F.lit("u")), 11) / F.lit(float(1 << 53))
        turn = F.xxhash64("doc_id", "h", F.lit(seed), F.lit(level), F.lit("turn"))
        return df.withColumn("turn", turn).withColumn("u", u).withColumn("open", F.lit(False)).select(names)

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id", "size", "h"], kind="stable")
        ps, open_ = round_group(pdf["p"].tolist(), pdf["size"].tolist(), pdf["u"].tolist())
        return pdf.assign(p=ps, open=[k == open_ for k in range(len(ps))])

    n = table.agg(F.max(F.ceil(F.col("n_docs") / group))).first()[0] or 0
    done, doubtful, level = drawn(unit.where("p <= 0"), 0), unit.where("p > 0"), 0
    while n:
        level += 1
        got = stored(drawn(doubtful, level).groupBy("source", "part").applyInPandas(rounded, schema), f"mix-level{level}")
        done = done.unionByName(got.where("not open"))
        doubtful = got.where("open").withColumn("part", F.floor(F.col("part") / group)).drop("turn", "u", "open")
        n = 0 if n == 1 else -(-n // group)
    last = drawn(doubtful, level + 1)
    done = done.unionByName(last.withColumn("p", (F.col("u") < F.col("p")).cast("double")))
    copies = (F.col("whole") + F.col("p").cast("bigint")).alias("copies")
    return done.select("doc_id", "source", "size", "h", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it. Rows of one id with different texts are rows of their own; rows that repeat
    id, source and text are numbered (by a hash of all columns), as the mix numbers them, and each is taken as often as its number."""
    names = {c: unused(docs, c) for c in ("id", "source", "h", "nth", "copies")}
    i, src, h, k, n = names.values()
    copies = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias(i), F.col("source").alias(src), F.col("h").alias(h), F.col("copies").alias(n))
    own = Window.partitionBy(id_col, source_col, F.xxhash64(text_col)).orderBy(F.xxhash64(*hashable(docs)))
    rows = docs.withColumn(k, (F.row_number().over(own) - 1).cast("bigint"))
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(src)) & (F.xxhash64(F.xxhash64(text_col), F.col(k)) == F.col(h))
    return rows.join(copies, same).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op1_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
