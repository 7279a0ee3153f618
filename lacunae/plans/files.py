"""Queries on files: the events of a table written as a platform's daily files, with preamble and marks of missing values, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers
from ..sources.tables import shared_path
from .base import EV, events, rounded, with_

HEIGHT = 38
LEAST_PACKETS = 5
RANGE = 1 << 16


def daily_files(spark, d) -> str:
    """A folder of one file a day: a line of preamble, the header, and a line for each event in the order of times and ids. A tenth of the values
    is marked 9999 and a tenth #N/A; packets are the id's remainder by 25."""
    e = events(spark, d)
    when = F.timestamp_seconds("t")
    mark = F.when(F.col("event_id") % 10 == 0, "9999").when(F.col("event_id") % 10 == 1, "#N/A").otherwise(F.col("v").cast("string"))
    line = F.concat_ws(",", F.date_format(when, "dd/MM/yyyy HH:mm:ss"), mark, (F.col("event_id") % 25).cast("string"))
    rows = e.select(F.date_format(when, "yyyyMMdd").alias("day"), F.col("t").alias("at"), F.col("event_id").alias("nth"), line.alias("value"))
    head = rows.select("day").distinct().withColumn("value", F.explode(F.array(F.concat(F.lit("Unit: "), F.substring("day", 7, 2)), F.lit(f"Time and Date,{readers.lidar_column(HEIGHT)},Packets in Average at {HEIGHT}m"))))
    head = head.select("day", F.when(F.col("value").startswith("Unit"), -2).otherwise(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("nth"), "value")
    path = shared_path(spark, "daily-files")
    rows.unionByName(head).repartition("day").sortWithinPartitions("day", "at", "nth").select("day", "value").write.partitionBy("day").text(path)
    return path


def lidar_files(spark, d):
    """Each day's file as read back: lines, missing values, mean, and the unit of its preamble. Files are read by ranges of bytes."""
    raw = readers.read_lidar(spark, daily_files(spark, d), HEIGHT, packets=True, range_bytes=RANGE)
    day = F.regexp_extract("file", r"day=(\d{8})", 1)
    got = raw.groupBy(day.alias("day")).agg(F.count("line").alias("lines"), F.count(F.when(F.col("missing"), 1)).alias("missing"), F.avg("v").alias("mean"), F.count(F.when(F.col("packets") < LEAST_PACKETS, 1)).alias("few"), F.max(F.regexp_extract("preamble", r"Unit:\s*(\w+)", 1)).alias("unit"))
    return rounded(got, 5)


def platform_files(spark, d):
    """The daily files as one platform on a ten-minute grid: of each day the grid points, those with a value, and their mean."""
    got, _ = readers.load_platform(spark, daily_files(spark, d), 600, HEIGHT, LEAST_PACKETS)
    return rounded(got.groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"), F.count("v").alias("valid"), F.avg("v").alias("mean")), 5)


def platform_report(spark, d):
    """What the loader tells of each file: lines, unreadable times, missing, masked and too few values, and why a file can't be used."""
    _, files = readers.load_platform(spark, daily_files(spark, d), 600, HEIGHT, LEAST_PACKETS)
    return files.select(F.regexp_extract("file", r"day=(\d{8})", 1).alias("day"), "lines", "bad_times", "missing", "masked", "too_few", "reason")


def latest_files(spark, d):
    """Lines of the files of the last five days that there are files of."""
    raw = readers.read_lidar(spark, daily_files(spark, d), HEIGHT)
    files = raw.groupBy("file").agg(F.count("line").alias("lines"), F.max("preamble").alias("preamble")).withColumn("day", F.regexp_extract("file", r"day=(\d{8})", 1))
    return readers.latest_days(files, 5).select("day", "lines")


_LINES = f"""li AS (SELECT strftime(make_timestamp(t * 1000000), '%Y%m%d') AS day, t, event_id, CASE WHEN event_id % 10 > 1 THEN v END AS v, event_id % 10 <= 1 AS missing, event_id % 25 AS packets FROM ev),
lv AS (SELECT *, v >= 100 OR v < 0 AS bad FROM li),
lp AS (SELECT *, CASE WHEN coalesce(bad, false) OR packets < {LEAST_PACKETS} THEN NULL ELSE v END AS x FROM lv)"""
_GRID = """ls AS (SELECT *, (round_even(t / 600.0::DOUBLE, 0) * 600)::BIGINT AS g FROM lp),
lf AS (SELECT g, x FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x IS NULL, day, t, event_id) AS nth FROM ls) WHERE nth = 1),
lg AS (SELECT p.t, x FROM (SELECT unnest(range(min(g), max(g) + 1, 600)) AS t FROM lf) p LEFT JOIN lf ON lf.g = p.t)"""

QUERIES: dict[str, tuple] = {
    "lidar_files": (lidar_files, with_([EV, _LINES], f"SELECT day, count(*) AS lines, count(*) FILTER (missing) AS missing, round(avg(v), 5) AS mean, count(*) FILTER (packets < {LEAST_PACKETS}) AS few, substr(day, 7, 2) AS unit FROM li GROUP BY day")),
    "platform_files": (platform_files, with_([EV, _LINES, _GRID], "SELECT t // 86400 AS day, count(*) AS n, count(x) AS valid, round(avg(x), 5) AS mean FROM lg GROUP BY 1")),
    "platform_report": (platform_report, with_([EV, _LINES], f"SELECT day, count(*) AS lines, 0::BIGINT AS bad_times, count(*) FILTER (missing) AS missing, count(*) FILTER (bad) AS masked, count(*) FILTER (v IS NOT NULL AND NOT bad AND packets < {LEAST_PACKETS}) AS too_few, NULL::VARCHAR AS reason FROM lv GROUP BY day")),
    "latest_files": (latest_files, with_([EV, _LINES], "SELECT day, count(*) AS lines FROM li WHERE day IN (SELECT day FROM (SELECT DISTINCT day FROM li) ORDER BY day DESC LIMIT 5) GROUP BY day")),
}
