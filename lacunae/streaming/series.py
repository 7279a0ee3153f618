"""Structured Streaming forms of the series operators. Batch stays the source of truth; these give the same rows on ordered input."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import ROLLS, feature_names, lags_up_to


def windowed_means(events: DataFrame, step: str, lateness: str, keys: list[str], time: str = "ts", value: str = "v") -> DataFrame:
    """Bin averages in append mode: a bin is given out once the watermark has passed its end."""
    bins = events.withWatermark(time, lateness).groupBy(*keys, F.window(time, step))
    return bins.agg(F.avg(value).alias("v"), F.count(value).alias("n")).select(*keys, F.col("window.start").alias("ts"), "v", "n")


def sessions(grid: DataFrame, step: str, lateness: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Segments of a gridded stream: rows a step apart are one session (a shorter step doesn't cut, as it does in batch)."""
    s = grid.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, step))
    return s.agg(F.count("*").alias("length"), F.min(time).alias("start"), F.max(time).alias("end")).drop("session_window")


class FeatureProcessor(StatefulProcessor):
    """Features of a series' rows in the order of their times, segment by segment, from the last `depth` rows of the segment.

    Rows wait as the lists they came in until the watermark has passed the latest of those that came with them; then all that are due are
    taken in order of time, whatever order they arrived in. Rows behind the watermark are late and left out. Of rows with one time the
    last to arrive counts. When the watermark passes the time at which a segment's next row was due, what is kept of it is dropped.
    State is read and written by the list, so the calls for it grow with batches and series, not with rows.
    """

    def __init__(self, depth: int, step: int, q: float, r: float):
        self.depth, self.step, self.q, self.r = depth, step, q, r

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "t array<bigint>, v array<double>, x double, p double, d bigint")
        self.waiting = handle.getListState("waiting", "t array<bigint>, v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed, came = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            part = part[part["t"] * 1000 > passed]
            if len(part):
                came.append((part["t"].tolist(), part["v"].tolist()))
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(max(max(times) for times, _ in came) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        rows = {}
        for part in self.waiting.get():
            rows.update(zip(*part, strict=True))
        due = sorted(t for t in rows if t <= now)
        kept = self.kept.get()
        if not due:  # the next row is overdue
            if kept and kept[0][-1] + self.step <= now and kept[0][-1] + self.step not in rows:
                self.kept.clear()
            return
        before, old, x, p, d = kept or ([], [], 0.0, 1.0, 0)
        n, times, values = len(before), np.array([*before, *due]), np.array([*old, *(rows[t] for t in due)], dtype=float)
        cut = np.append(True, np.diff(times) != self.step)
        begin = np.maximum.accumulate(np.where(cut, np.arange(len(times)), 0))
        levels, places = [], []
        for z, first in zip(values[n:].tolist(), cut[n:].tolist(), strict=True):
            if first:
                x, p, d = z, 1.0, 0
            else:
                m = p + self.q
                k = m / (m + self.r)
                x, p = x + k * (z - x), (1 - k) * m
            d += 1
            levels.append(x), places.append(d)
        made = pd.DataFrame({name: c[n:] for name, c in features_of(values, begin, self.depth).items()})
        angle = times[n:] % 86400 // 3600 * (2 * math.pi / 24)
        yield made.assign(series_id=key[0], t=times[n:], v=values[n:], d=places, kalman=levels, hour_sin=np.sin(angle), hour_cos=np.cos(angle))[["series_id", "t", "v", "d", *feature_names(self.depth)]]
        later = [(t, v) for t, v in rows.items() if t > now]
        if later:
            self.waiting.put([tuple(map(list, zip(*later, strict=True)))])
        else:
            self.waiting.clear()
        tail = max(begin[-1], len(times) - self.depth)
        self.kept.update((times[tail:].tolist(), values[tail:].tolist(), float(x), float(p), int(d)))
        self.handle.registerTimer((int(times[-1]) + self.step) * 1000)


def features_of(v: np.ndarray, begin: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """The window features of values, as build_features makes them within segments. begin: the place at which each value's segment begins."""
    place = np.arange(len(v)) - begin

    def back(k: int) -> np.ndarray:
        out = np.full(len(v), np.nan)
        out[k:] = v[: max(0, len(v) - k)]
        return np.where(place >= k, out, np.nan)

    def rolled(w: int) -> tuple[np.ndarray, np.ndarray]:
        mean, std = np.full((2, len(v)), np.nan)
        if len(v) >= w:
            over = np.lib.stride_tricks.sliding_window_view(v, w)
            mean[w - 1 :], std[w - 1 :] = over.mean(axis=1), over.std(axis=1, ddof=1)
        return np.where(place >= w - 1, mean, np.nan), np.where(place >= w - 1, std, np.nan)

    out = {"lag_0": v} | {f"lag_{k}": back(k) for k in lags_up_to(depth)}
    for w in (w for w in ROLLS if w <= depth):
        out[f"roll_mean_{w}"], out[f"roll_std_{w}"] = rolled(w)
    n = min(30, depth)
    mean, std = rolled(n) if n > 1 else np.full((2, len(v)), np.nan)
    return out | {"shear": v - back(1), "turbulence": std / (mean + 1e-9)}


def online_features(rows: DataFrame, step: int, depth: int, lateness: str = "0 seconds", q: float = 0.02, r: float = 0.6) -> DataFrame:
    """rows (series_id, t, v) with d (place after the last gap) and the features of features.build_features within segments, as soon as the
    watermark has passed them. The state of a series is its segment's last `depth` rows and what waits for the watermark."""
    use_rocksdb(rows.sparkSession)
    names = ", ".join(f"{n} double" for n in feature_names(depth))
    timed = rows.select("series_id", "t", "v", F.timestamp_seconds("t").alias("ts")).withWatermark("ts", lateness)
    return timed.groupBy("series_id").transformWithStateInPandas(FeatureProcessor(depth, step, q, r), f"series_id string, t bigint, v double, d bigint, {names}", "Append", "EventTime")


def use_rocksdb(spark) -> None:
    """State of several kinds needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def online_levels(rows: DataFrame, step: int, lateness: str = "0 seconds", q: float = 0.02, r: float = 0.6) -> DataFrame:
    """Kalman level and distance from the last gap (series_id, t, v, kalman, d), as online_features gives them."""
    return online_features(rows, step, 1, lateness, q, r).select("series_id", "t", "v", "kalman", "d")


def online_errors(forecasts: DataFrame, observations: DataFrame, lateness: str, keys: list[str]) -> DataFrame:
    """Each forecast with the observation that it was for: forecasts (keys, target_ts, prediction, d) meet observations (keys, ts, v).

    Either waits for the other until the watermarks of both have passed its time; what has found none by then is dropped from the state, so
    a forecast into a gap gives no row. Rows behind the watermark are late and meet nobody.
    """
    f = forecasts.withWatermark("target_ts", lateness)
    o = observations.select(*[F.col(k).alias(f"_o_{k}") for k in keys], "ts", F.col("v").alias("target")).withWatermark("ts", lateness)
    same = F.col("target_ts") == F.col("ts")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_o_{k}"))
    e = F.col("target") - F.col("prediction")
    return f.join(o, same).select(*keys, "target_ts", "d", "prediction", "target", (e * e).alias("sq"))


def error_counters(scored: DataFrame, keys: list[str], depth: int, most: int = 12) -> DataFrame:
    """n and sum of squares for each distance up to `most`, and under a null distance for the far ones (beyond depth). Complete mode: few rows."""
    near = F.when(F.col("d") <= most, F.col("d"))
    both = F.explode(F.array_compact(F.array(F.when(near.isNotNull(), F.struct(near.alias("d"))), F.when(F.col("d") > depth, F.struct(F.lit(None).cast("bigint").alias("d"))))))
    return scored.select(*keys, "sq", both.alias("_d")).groupBy(*keys, F.col("_d.d").alias("d")).agg(F.count("*").alias("n"), F.sum("sq").alias("sum_sq"))


def profile_of_counters(counters: DataFrame, keys: list[str], least: int = 15) -> DataFrame:
    """distance_profile (n, rmse, far_rmse, n_far, inflation) from error_counters."""
    root = F.sqrt(F.col("sum_sq") / F.col("n"))
    far = counters.where("d is null").select(*keys, root.alias("far_rmse"), F.col("n").alias("n_far"))
    near = counters.where(F.col("d").isNotNull() & (F.col("n") >= least)).select(*keys, "d", "n", root.alias("rmse"))
    return near.join(far, keys).withColumn("inflation", 100 * (F.col("rmse") / F.col("far_rmse") - 1))
