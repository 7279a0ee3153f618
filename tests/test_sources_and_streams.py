"""Readers, writers and streaming forms, on files made by the tests."""

import datetime as dt

from pyspark.sql import functions as F

from lacunae.operators import features, grid, segments
from lacunae.sources import readers
from lacunae.streaming import series as stream

COLUMN = readers.lidar_column(38)


def lidar_files(folder):
    (folder / "Wind_10min_20240101.csv").write_text(f"Unit: 7\nTime and Date,Other,{COLUMN},Packets in Average at 38m\n01/01/2024 00:00:00,1,5.5,20\n01/01/2024 00:10:00,1,9999,20\nnot a date,1,6.5,20\n01/01/2024 00:30:00,1,#N/A,3\n")
    (folder / "Wind_10min_20240102.CSV").write_text(f"Unit: 8\nTime and Date,{COLUMN},Packets in Average at 38m\n02/01/2024 00:00:00,7.25,2\n")
    return str(folder)


def test_lidar(spark, tmp_path):
    df = readers.read_lidar(spark, lidar_files(tmp_path), packets=True)
    rows = sorted((str(r.ts), r.v, r.packets) for r in df.collect())
    assert rows == [("2024-01-01 00:00:00", 5.5, 20), ("2024-01-01 00:10:00", None, 20), ("2024-01-01 00:30:00", None, 3), ("2024-01-02 00:00:00", 7.25, 2), ("None", 6.5, 20)]
    few = grid.require_packets(df, 5)
    assert few.where("too_few").count() == 1
    facts = {(str(r.day), r.unit) for r in readers.file_facts(df).collect()}
    assert facts == {("2024-01-01", "7"), ("2024-01-02", "8")}
    assert df.where(readers.has_token(F.col("file"), "10MIN")).count() == 5


def test_onshore_and_heights(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,WindSpeed\n2024-01-01 00:00:00,3.5\n2024-01-01 00:10:00,oops\n")
    got = readers.load(spark, "onshore", str(tmp_path)).orderBy("ts").collect()
    assert [(r.t, r.v) for r in got] == [(1704067200, 3.5), (1704067800, None)]
    (tmp_path / "b.csv").write_text("Time,WindSpeed\n")
    try:
        readers.load(spark, "onshore", str(tmp_path))
        raise AssertionError("two files were read")
    except ValueError:
        pass
    rows = [(dt.datetime(2024, 1, 1), [10.0, 38.5, 57.0], [1.0, 2.0, 3.0], [0, 0, 0]), (dt.datetime(2024, 1, 2), [10.0, 57.0], [1.0, 3.0], [0, 0]), (dt.datetime(2024, 1, 3), [38.0], [4.0], [1])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, height array<double>, hws array<double>, qc array<int>")
    assert [r.v for r in readers.nearest_height(df, 38.0).orderBy("ts").collect()] == [2.0, None, None]


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "record string, x int")
    readers.write_results(df, str(tmp_path / "p"), ["record"])
    readers.write_results(df.where("record = 'a'").withColumn("x", F.lit(5)), str(tmp_path / "p"), ["record"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("record", "x").collect()} == {("a", 5), ("b", 2)}
    readers.write_results(df, str(tmp_path / "c"), csv=True)
    assert readers.read_results(spark, str(tmp_path / "c")).count() == 2 and readers.read_results(spark, str(tmp_path / "none")) is None
    assert readers.text_report(df.orderBy("x"))[1] == "a\t1"


def run_stream(spark, df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    t0 = 1704067200
    rows = [("x", t0 + 600 * k, float(k % 7)) for k in range(40) if k not in (10, 11, 25)]
    batch = spark.createDataFrame(rows, "series_id string, t bigint, v double")
    batch.withColumn("ts", F.timestamp_seconds("t")).repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("series_id string, t bigint, v double, ts timestamp").parquet(str(tmp_path / "in"))
    levels = run_stream(spark, stream.online_levels(source, 600), "levels", tmp_path / "c1")
    want = features.kalman_level(segments.segment_ids(batch, 600), ["series_id", "seg"]).select("t", "kalman")
    assert sorted(map(tuple, levels.select("t", "kalman").collect())) == sorted(map(tuple, want.collect()))
    means = run_stream(spark, stream.windowed_means(source, "1 hour", "0 seconds", ["series_id"]), "means", tmp_path / "c2")
    hourly = {r.t: r.v for r in grid.resample(batch, 3600).collect()}
    got = {r.s: r.v for r in means.select(F.unix_timestamp("ts").alias("s"), "v").collect()}
    assert got and all(hourly[t] == v for t, v in got.items())
    found = run_stream(spark, stream.sessions(source, "10 minutes", "0 seconds", ["series_id"]), "found", tmp_path / "c3")
    lengths = {r.length for r in segments.segment_lengths(segments.segment_ids(batch, 600)).collect()}
    assert {r.length for r in found.collect()} <= lengths


def test_platform_of_daily_files(spark, tmp_path):
    head = "Time and Date,Horizontal Wind Speed (m/s) at 38m,Packets in Average at 38m"
    day = lambda name, *rows, top=head: (tmp_path / name).write_text("\n".join(["Unit: 7", top, *rows]) + "\n")
    day("x_20240101.csv", '01/01/2024 00:00:00,5.0,20', '"01/01/2024 00:09:59","6,0",20', "01/01/2024 00:20:00,9999,20", "no time,3.0,20", "01/01/2024 00:40:00,150,20", "01/01/2024 00:50:00,4.0,2")
    day("x_20240102.csv", "01/01/2024 00:20:00,7.5,20", "01/01/2024 00:00:00,8.0,20")
    day("x_20240103.csv", "03/01/2024 00:00:00,1.0", top="Time and Date,Something else")
    day("x_20240104.csv", "04-01-2024,1.0,20")
    grid, files = readers.load_platform(spark, str(tmp_path), least_packets=5)
    t0 = 1704067200
    assert [(r.t - t0, r.v) for r in grid.orderBy("t").collect()] == [(0, 5.0), (600, None), (1200, 7.5), (1800, None), (2400, None), (3000, None)]
    got = {r.file[-6:-4]: (r.lines, r.bad_times, r.missing, r.masked, r.too_few, r.reason) for r in files.collect()}
    assert got == {"01": (6, 1, 1, 1, 1, None), "02": (2, 0, 0, 0, 0, None), "03": (1, 0, 0, 0, 0, "no such column"), "04": (1, 1, 0, 0, 0, "no readable time")}


def test_latest_days_and_unfinished_parts(spark, tmp_path):
    files = spark.createDataFrame([(f"f{k}", k // 2) for k in range(20)] + [("x", None)], "file string, day int")
    assert {r.day for r in readers.latest_days(files, 3).collect()} == {7, 8, 9}
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "record string, h int")
    path = str(tmp_path / "out")
    assert readers.unfinished(parts, path, ["record", "h"]).count() == 3
    readers.write_results(parts.where("record = 'a'").withColumn("skill", F.lit(1.0)), path, ["record", "h"])
    assert [tuple(r) for r in readers.unfinished(parts, path, ["record", "h"]).collect()] == [("b", 1)]


def test_report_tells_that_rows_are_left_out(spark):
    df = spark.range(5)
    assert readers.text_report(df, 3)[-1] == "... more rows" and len(readers.text_report(df, 3)) == 5
    assert len(readers.text_report(df, 5)) == 6
