"""Series that the registered queries work on, and the same in DuckDB SQL.

Events of each type are series, averaged in bins of an hour; smaller bins give many short gaps. A type has one series for each
PER_SERIES events in the table, of users by the remainder of their ids, so that larger tables have more series, not denser ones, and
gaps at every size. Times are seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import in_order, last_rows, seconds
from ..operators import blocked, features, grid, origins, segments
from ..sources.tables import stored

STEP = 3600
#: Depth, window length and horizon of the registered queries: the small tables have few long segments.
DEPTH, SEQ, H = 5, 4, 1


#: Events of all types in the table for each group of users, whose events of one type are a series.
PER_SERIES = 10_000


def user_groups(spark: SparkSession, sf_dir: str) -> int:
    """Groups of users: one for each PER_SERIES rows of events (a count from the files' footers)."""
    return max(1, spark.read.parquet(f"{sf_dir}/events.parquet").count() // PER_SERIES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), user_groups(spark, sf_dir)
    name = F.col("event_type") if n == 1 else F.concat("event_type", F.lit("-"), F.pmod(F.coalesce("user_id", F.lit(0)), F.lit(n)).cast("string"))
    return e.select(name.alias("series_id"), seconds(F.col("ts")).alias("t"), F.col("value").alias("v"), "event_id").where("v is not null")


def series(spark: SparkSession, sf_dir: str, step: int = STEP, order: str | None = None) -> DataFrame:
    return grid.resample(events(spark, sf_dir), step, order=order)


def segmented(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    return segments.segment_ids(series(spark, sf_dir, step), step)


def placed_rows(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    """The series with segments and all places (blocked.placed), written once for all that reads it."""
    return stored(blocked.placed(series(spark, sf_dir, step), step), "placed")


_PLACES = ("_r", "_c", "_p", "_n")


def _naive(placed: DataFrame, horizon: int) -> DataFrame:
    """placed rows with target by row position, whether it is displaced, and the mean of the last 5 rows as m5, by blocks of rows."""
    own = ["series_id", "_blk"]
    s = features.with_target(blocked.with_halo(placed, 4, horizon), horizon, own)
    over = last_rows(own, 5)
    s = s.select("*", F.coalesce(features.displaced(horizon, STEP), F.lit(False)).alias("displaced"), F.when(F.count("v").over(over) == 5, F.avg("v").over(over)).alias("m5"))
    return s.where("_own").drop("_blk", "_own")


def naive_rows(spark: SparkSession, sf_dir: str, horizon: int = H) -> DataFrame:
    """Segmented series with target by row position, whether it is displaced, and the mean of the last 5 rows as m5."""
    return _naive(placed_rows(spark, sf_dir), horizon).drop(*_PLACES)


def valid_rows(spark: SparkSession, sf_dir: str, depth: int = DEPTH, horizon: int = H) -> DataFrame:
    return origins.valid_origins(placed_rows(spark, sf_dir), depth, SEQ, horizon).drop(*_PLACES)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def scored_rows(spark: SparkSession, sf_dir: str, horizon: int = H) -> DataFrame:
    """Naive rows with target, scored by m5 and by persistence, with distances from gaps: one frame, dealt once to blocks of rows."""
    rows = segments.distances(stored(_naive(placed_rows(spark, sf_dir), horizon), "naive-rows"), STEP)
    sq = lambda p: (F.col("target") - F.col(p)) * (F.col("target") - F.col(p))
    names = ("series_id", "t", "v", "seg", "target", "target_t", "displaced", "m5", "d", "gap_before", "to_gap")
    return rows.where("target is not null and m5 is not null").select(*names, sq("m5").alias("sq_m"), sq("v").alias("sq_p"), sq("v").alias("sq"))


def order():
    return in_order(["series_id"])


# --- the same in SQL -------------------------------------------------------------------------------------------------

EV = f"""ev AS (SELECT CASE WHEN groups = 1 THEN event_type ELSE event_type || '-' || (coalesce(user_id, 0) % groups) END AS series_id, epoch_us(ts) // 1000000 AS t, value AS v, event_id
  FROM events, (SELECT greatest(1, count(*) // {PER_SERIES}) AS groups FROM events) WHERE value IS NOT NULL)"""


def s_sql(step: int = STEP, name: str = "s") -> str:
    return f"{name} AS (SELECT series_id, t - t % {step} AS t, avg(v) AS v FROM ev GROUP BY 1, 2)"


def grid_sql(step: int = STEP, source: str = "s", name: str = "g") -> str:
    return f"{name} AS (SELECT series_id, t, v FROM (SELECT series_id, unnest(range(min(t), max(t) + 1, {step})) AS t FROM {source} GROUP BY series_id) LEFT JOIN {source} USING (series_id, t))"


def seg_sql(step: int = STEP, source: str = "s", name: str = "seg") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (b), (sum(b) OVER (PARTITION BY series_id ORDER BY t))::BIGINT AS seg
  FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t) <> {step} THEN 1 ELSE 0 END AS b FROM {source}))"""


LEN = "len AS (SELECT series_id, seg, count(*) AS length, min(t) AS start, max(t) AS \"end\" FROM seg GROUP BY 1, 2)"


def naive_sql(h: int = H) -> str:
    return f"""nv AS (SELECT *, coalesce(target_t - t > {h * STEP}, false) AS displaced FROM (SELECT *, lead(v, {h}) OVER w AS target, lead(t, {h}) OVER w AS target_t,
  CASE WHEN count(v) OVER f = 5 THEN avg(v) OVER f END AS m5 FROM seg
  WINDOW w AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""


def valid_sql(depth: int = DEPTH, seq: int = SEQ, h: int = H, name: str = "va") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (p, n) FROM (SELECT *, lead(v, {h}) OVER w AS target, lead(t, {h}) OVER w AS target_t, row_number() OVER w - 1 AS p,
  count(*) OVER (PARTITION BY series_id, seg) AS n FROM seg WINDOW w AS (PARTITION BY series_id, seg ORDER BY t)) WHERE p >= {max(depth, seq - 1)} AND n - p - 1 >= {h})"""


def split_sql(source: str = "va", name: str = "sp", seq: int = SEQ, h: int = H, least: int = 40, least_test: int = 5) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (r, c), CASE WHEN r < floor(c * 0.75) THEN 'train' WHEN r >= floor(c * 0.75) + {seq + h} THEN 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS c FROM {source})
  WHERE c >= {least} AND c - (floor(c * 0.75) + {seq + h}) >= {least_test})"""


BOUNDS = "bo AS (SELECT series_id, max(t) FILTER (split = 'train') AS train_end, min(t) FILTER (split = 'test') AS test_start, max(t) FILTER (split = 'test') AS test_end FROM sp GROUP BY 1)"
CALENDAR = """cs AS (SELECT nv.*, CASE WHEN t <= train_end AND target_t < test_start THEN 'train' WHEN t BETWEEN test_start AND test_end THEN 'test' END AS split
  FROM nv JOIN bo USING (series_id) WHERE target IS NOT NULL)"""

DIST = f"""di AS (SELECT series_id, t, v, seg, d, gap_before, CASE WHEN more THEN size - d + 1 ELSE 1000000000 - (t - t0) // {STEP} END AS to_gap
  FROM (SELECT seg.*, row_number() OVER (PARTITION BY series_id, seg ORDER BY t) AS d, count(*) OVER (PARTITION BY series_id, seg) AS size FROM seg)
  JOIN (SELECT series_id, seg, coalesce((start - lag("end") OVER w) // {STEP} - 1, 0) AS gap_before, lead(seg) OVER w IS NOT NULL AS more, min(start) OVER (PARTITION BY series_id) AS t0
    FROM len WINDOW w AS (PARTITION BY series_id ORDER BY seg)) USING (series_id, seg))"""
SCORED = """sc AS (SELECT nv.*, d, gap_before, to_gap, (target - m5) * (target - m5) AS sq_m, (target - nv.v) * (target - nv.v) AS sq_p, (target - nv.v) * (target - nv.v) AS sq
  FROM nv JOIN di USING (series_id, t) WHERE target IS NOT NULL AND m5 IS NOT NULL)"""

BASE = [EV, s_sql()]
SEGS = [*BASE, seg_sql()]
SCORES = [*SEGS, LEN, naive_sql(), DIST, SCORED]


def with_(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" + body
