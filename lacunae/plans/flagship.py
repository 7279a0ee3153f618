"""The flagship query: what ignoring gaps does to a persistence score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rmse
from ..operators.blocked import with_halo
from ..operators.features import with_target
from .base import DEPTH, LEN, SEGS, SEQ, H, naive_sql, placed_rows, rounded, valid_sql, with_

K = ["series_id"]


def exposure_report(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """For each series: rows and valid origins (counted and by formula), exposure, persistence errors on either."""
    rows = with_target(with_halo(placed_rows(spark, sf_dir), 0, H), H, [*K, "_blk"]).where("_own")
    error, ok = F.col("target") - F.col("v"), (F.col("_p") >= max(depth, SEQ - 1)) & (F.col("_n") - F.col("_p") - 1 >= H)
    # a segment's formula, max(0, L - W - H), is counted at its first row
    formula = F.sum(F.when(F.col("_p") == 0, F.greatest(F.lit(0), F.col("_n") - depth - H)))
    whole = F.count("*") - depth - H
    out = rows.groupBy(*K).agg(
        F.count("target").alias("n_naive"), rmse(error).alias("rmse_naive"), F.count(F.when(ok, F.col("target"))).alias("n_valid"), rmse(F.when(ok, error)).alias("rmse_valid"),
        formula.alias("n_formula"), F.when(whole > 0, formula / whole).alias("retention"),
    )
    return rounded(out.where("n_naive > 0").withColumn("exposure", 1 - F.col("n_valid") / F.col("n_naive")))


SQL = with_(
    [*SEGS, LEN, naive_sql(), valid_sql()],
    f"""SELECT series_id, n_naive, round(rmse_naive, 6) AS rmse_naive, coalesce(n_valid, 0) AS n_valid, round(rmse_valid, 6) AS rmse_valid, n_formula,
  round(CASE WHEN total - {DEPTH} - 1 > 0 THEN n_formula / (total - {DEPTH} - 1) END, 6) AS retention, round(1 - coalesce(n_valid, 0) / n_naive, 6) AS exposure
FROM (SELECT series_id, count(*) AS n_naive, sqrt(avg((target - v) * (target - v))) AS rmse_naive FROM nv WHERE target IS NOT NULL GROUP BY 1)
LEFT JOIN (SELECT series_id, count(*) AS n_valid, sqrt(avg((target - v) * (target - v))) AS rmse_valid FROM va GROUP BY 1) USING (series_id)
JOIN (SELECT series_id, sum(greatest(0, length - {DEPTH} - 1))::BIGINT AS n_formula, sum(length) AS total FROM len GROUP BY 1) USING (series_id)""",
)
QUERIES = {"exposure_report": (exposure_report, SQL)}
