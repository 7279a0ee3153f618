"""Readers of observation files into (series_id, ts, v), and writers of result tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import seconds
from ..operators.grid import coerce, dedupe_prefer_valid, mask_sentinels, reindex, require_packets, snap_to_grid
from .preambled import PreambledCsv

#: Spellings of missing values in lidar files. Fixed values.
MISSING = ("#N/A", "9999", "")


def lidar_column(height: int) -> str:
    return f"Horizontal Wind Speed (m/s) at {height}m"


def read_preambled_csv(spark: SparkSession, path: str, columns: dict[str, str], range_bytes: int | None = None) -> DataFrame:
    """Text columns (file's name -> ours) of CSV files whose header follows some preamble lines, with file, line (the byte at which it begins),
    preamble (the file's first line) and reason (why a file can't be read; such a file has one row of nothing else). See preambled."""
    spark.dataSource.register(PreambledCsv)
    read = spark.read.format("preambled_csv").option("columns", json.dumps(columns))
    read = read.option("rangeBytes", str(range_bytes)) if range_bytes else read
    return read.load(path).withColumnRenamed("at", "line")


def not_missing(c: str):
    return F.when(~F.col(c).isin(*MISSING), F.col(c))


def read_lidar(spark: SparkSession, path: str, height: int = 38, series_id: str = "D1", packets: bool = False, range_bytes: int | None = None) -> DataFrame:
    """Lidar files: series_id, ts, v (and packets), unreadable values and missing marks as null, with file and line, whether the file has the
    value's column, and whether the value is marked missing."""
    names = {"Time and Date": "time", lidar_column(height): "value"} | ({f"Packets in Average at {height}m": "n"} if packets else {})
    raw = read_preambled_csv(spark, path, names, range_bytes)
    got = coerce(raw.withColumn("raw", F.col("value")).withColumn("value", not_missing("value")), "value", "time", "dd/MM/yyyy HH:mm:ss")
    extra = [F.expr("try_cast(n AS int)").alias("packets")] if packets else []
    got = got.withColumn("has_column", F.col("raw").isNotNull()).withColumn("missing", F.col("has_column") & F.col("value").isNull())
    return got.select(F.lit(series_id).alias("series_id"), "ts", seconds(F.col("ts")).alias("t"), "v", *extra, "file", "line", "preamble", "has_column", "missing", "reason")


def read_onshore(spark: SparkSession, path: str, series_id: str = "D3") -> DataFrame:
    """One CSV file with Time and WindSpeed."""
    raw = spark.read.option("header", True).schema("Time string, WindSpeed string").csv(path)
    if len(raw.inputFiles()) != 1:
        raise ValueError(f"exactly one file is expected, {path} has {len(raw.inputFiles())}")
    got = coerce(raw, "WindSpeed", "Time", "yyyy-MM-dd HH:mm:ss")
    return got.select(F.lit(series_id).alias("series_id"), "ts", seconds(F.col("ts")).alias("t"), "v")


def nearest_height(df: DataFrame, wanted: float, tolerance: float = 2.0) -> DataFrame:
    """v of the height nearest to the wanted one (null beyond the tolerance or where its qc isn't 0).

    df: ts, height, hws and qc arrays, as a netCDF decoder gives them.
    """
    levels = F.transform(F.arrays_zip("height", "hws", "qc"), lambda x: F.struct(F.abs(x["height"] - wanted).alias("off"), x["hws"].alias("v"), x["qc"].alias("qc")))
    best = F.array_min(levels)
    return df.withColumn("_b", best).withColumn("v", F.when((F.col("_b.off") <= tolerance) & (F.col("_b.qc") == 0), F.col("_b.v"))).drop("_b", "height", "hws", "qc")


def file_facts(df: DataFrame) -> DataFrame:
    """Of rows with file and preamble: the file's day (from its name) and unit (from its first line)."""
    return df.select("file", F.to_date(F.regexp_extract("file", r"(\d{8})", 1), "yyyyMMdd").alias("day"), F.regexp_extract("preamble", r"Unit:\s*(\w+)", 1).alias("unit")).distinct()


def has_token(name, token: str):
    """Whether a file name holds a token between separators, in either case."""
    return F.array_contains(F.split(F.translate(F.lower(name), "-. ", "___"), "_"), token.lower())


def load_platform(spark: SparkSession, path: str, step: int = 600, height: int = 38, least_packets: int | None = None, series_id: str = "platform", high: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """A platform's daily files as one series on a complete grid, and a report of the files.

    Rows are masked (sentinels, too few packets), snapped to the grid, and of rows at one grid point a measurement goes before a missing
    value, then the earlier file and line. A file that can't be used (no such column, no readable time) fails by itself: it adds no rows
    and the report gives its reason, beside its counts of lines, unreadable times, missing, masked and too few.
    """
    raw = read_lidar(spark, path, height, series_id, least_packets is not None)
    marked = mask_sentinels(raw, high)
    marked = require_packets(marked, least_packets) if least_packets is not None else marked.withColumn("too_few", F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    files = marked.groupBy("file").agg(
        F.count("line").alias("lines"), count(F.col("line").isNotNull() & F.col("ts").isNull()).alias("bad_times"), count(F.col("missing")).alias("missing"), count(F.col("masked")).alias("masked"), count(F.col("too_few")).alias("too_few"),
        F.coalesce(F.max("reason"), F.when(count(F.col("has_column")) == 0, "no such column").when(F.count("ts") == 0, "no readable time")).alias("reason"),
    )
    good = marked.where("ts is not null and has_column")
    snapped = dedupe_prefer_valid(snap_to_grid(good.select("series_id", "t", "v", "file", "line"), step), ["file", "line"])
    return reindex(snapped.select("series_id", "t", "v"), step), files


def latest_days(files: DataFrame, most: int, by: list[str] | None = None, day: str = "day") -> DataFrame:
    """Rows of the last `most` days that there are files of (of each group)."""
    place = F.dense_rank().over(Window.partitionBy(*(by or [])).orderBy(F.desc(day)))
    return files.where(F.col(day).isNotNull()).withColumn("_p", place).where(F.col("_p") <= most).drop("_p")


def unfinished(parts: DataFrame, path: str, by: list[str]) -> DataFrame:
    """The parts (rows of the columns by) that the result table at path doesn't hold yet: a job that was broken off goes on with those.

    A part that write_part has written counts as held though it gave no rows."""
    left = parts
    for place in (path, f"{path}-parts"):
        try:
            done = parts.sparkSession.read.parquet(place).select(by).distinct()
        except AnalysisException as none:
            if not any(x in str(none) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
        else:
            left = left.join(done, by, "left_anti")
    return left


def write_part(df: DataFrame, path: str, part: dict) -> None:
    """One part of a result table (df has its columns), then a row beside the table that says it is done."""
    write_results(df, path, list(part))
    df.sparkSession.createDataFrame([tuple(part.values())], list(part)).write.mode("append").parquet(f"{path}-parts")


LOADERS: dict[str, Callable[..., DataFrame]] = {"lidar": read_lidar, "onshore": read_onshore, "platform": lambda *a, **k: load_platform(*a, **k)[0]}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    return LOADERS[kind](spark, path, **options)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """A result table written earlier; None where there is none."""
    try:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    except AnalysisException as none:
        if "PATH_NOT_FOUND" not in str(none):
            raise
        return None


def write_results(df: DataFrame, path: str, by: list[str] | None = None, csv: bool = False) -> None:
    """A result table, partitioned by the given columns so that finished parts stay when others are run again."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w = w.partitionBy(*by) if by else w
    w.option("header", True).csv(path) if csv else w.parquet(path)


def text_report(df: DataFrame, most: int = 1000) -> list[str]:
    """Lines of a result table for a text report. Of a table with more than `most` rows the last line tells that others follow."""
    rows = df.limit(most + 1).collect()
    lines = ["\t".join(df.columns), *("\t".join("" if x is None else str(x) for x in r) for r in rows[:most])]
    return lines + ["... more rows"] * (len(rows) > most)
