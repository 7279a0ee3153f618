"""Stateful streams against batch, with rows that come late or out of order."""

import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacunae.operators import features, segments
from lacunae.streaming import series as stream

T0 = 1704067200
STEP = 600


def batches(spark, folder, parts, schema):
    """One file a part, read one a batch in this order."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


@pytest.fixture(scope="module", autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_features_with_late_rows(spark, tmp_path):
    rows = [("x", T0 + STEP * k, float(k * 7 % 11)) for k in range(60) if k not in (10, 11, 25)]
    early, later = [r for r in rows if r[1] < T0 + STEP * 30], [r for r in rows if r[1] >= T0 + STEP * 30]
    late = [("x", T0 + STEP * 10, 99.0)]  # behind the watermark of the first batch: left out
    source = batches(spark, tmp_path / "in", [early[::-1], later[::-1] + late], "series_id string, t bigint, v double")
    got = {r.t: r for r in run(spark, stream.online_features(source, STEP, 5), "late_features", tmp_path / "c")}
    batch = spark.createDataFrame(rows, "series_id string, t bigint, v double")
    want = features.build_features(segments.segment_ids(batch, STEP), 5, ["series_id", "seg"]).collect()
    assert set(got) == {r.t for r in want}
    for r in want:
        for n in features.feature_names(5):
            assert (r[n] is None and got[r.t][n] is None) or got[r.t][n] == pytest.approx(r[n], abs=1e-9)


def test_a_row_within_the_lateness_counts(spark, tmp_path):
    rows = [("x", T0 + STEP * k, float(k)) for k in range(12)]
    source = batches(spark, tmp_path / "in", [[r for k, r in enumerate(rows[:8]) if k != 6], [rows[6], *rows[8:]]], "series_id string, t bigint, v double")
    got = {r.t: r.d for r in run(spark, stream.online_levels(source, STEP, "30 minutes"), "waited", tmp_path / "c")}
    assert [got[T0 + STEP * k] for k in range(8)] == list(range(1, 9))  # row 6 came a batch later, and nothing was cut


def test_sessions_reopen_or_drop(spark, tmp_path):
    at = lambda *ks: [("x", spark.sql(f"select timestamp_seconds({T0 + STEP * k})").first()[0]) for k in ks]
    # 3 is within the lateness and joins two sessions; 1 comes after the session was closed (a batch after the watermark passed it)
    parts = [at(0, 1, 2, 4, 5), at(3, 30), at(40), at(1, 60)]
    source = batches(spark, tmp_path / "in", parts, "series_id string, ts timestamp")
    got = sorted(r.length for r in run(spark, stream.sessions(source, "10 minutes", "1 hour", ["series_id"]), "reopened", tmp_path / "c"))
    assert got == [1, 1, 6]


def test_errors_meet_by_time(spark, tmp_path):
    ts = lambda k: spark.sql(f"select timestamp_seconds({T0 + STEP * k})").first()[0]
    forecasts = [("x", ts(k + 1), float(k), k + 1) for k in range(6)]
    observed = [("x", ts(k), float(k) + 2) for k in (1, 2, 4, 5, 6)]  # none at 3
    f = batches(spark, tmp_path / "f", [forecasts], "series_id string, target_ts timestamp, prediction double, d bigint")
    o = batches(spark, tmp_path / "o", [observed[:2], observed[2:]], "series_id string, ts timestamp, v double")
    got = {r.d: r.sq for r in run(spark, stream.online_errors(f, o, "1 hour", ["series_id"]), "met", tmp_path / "c")}
    assert got == {d: 9.0 for d in (1, 2, 4, 5, 6)}
    counts = stream.error_counters(spark.createDataFrame([("x", d, s) for d, s in got.items()], "series_id string, d bigint, sq double"), ["series_id"], 4, most=5)
    rows = {r.d: (r.n, r.sum_sq) for r in counts.collect()}
    assert rows == {1: (1, 9.0), 2: (1, 9.0), 4: (1, 9.0), 5: (1, 9.0), None: (2, 18.0)}
    assert stream.profile_of_counters(counts, ["series_id"], 1).where("inflation = 0").count() == 4


class Calls:
    """State of one series in memory that counts how often it is asked."""

    def __init__(self):
        self.n, self.timers = 0, []

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def __getattr__(self, kind):
        if not kind.startswith("get"):
            raise AttributeError(kind)
        return lambda *_: State(self)


class State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, call):
        def asked(*args):
            self.calls.n += 1
            if call == "get":
                return self.value if self.value is not None or self.calls.values is self else []
            if call == "appendList":
                self.value = [*(self.value or []), *args[0]]
            elif call in ("put", "update"):
                self.value = args[0]
            elif call == "clear":
                self.value = None

        return asked


@pytest.mark.parametrize("n", [40, 400])
def test_calls_for_state_do_not_grow_with_rows(n):
    calls = Calls()
    made = stream.FeatureProcessor(5, STEP, 0.02, 0.6)
    made.init(calls)
    calls.values = made.kept
    rows = pd.DataFrame({"t": [T0 + STEP * k for k in range(n) if k % 9], "v": [float(k) for k in range(n) if k % 9]})
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    list(made.handleInputRows(("x",), iter([rows[:20], rows[20:]]), watermark))
    (got,) = made.handleExpiredTimer(("x",), watermark, SimpleNamespace(getExpiryTimeInMs=lambda: calls.timers[-1]))
    assert got["t"].tolist() == rows["t"].tolist() and got["d"].max() == 8 and got["lag_5"].notna().sum() == sum(k % 9 > 5 for k in range(n))
    assert calls.n <= 5
