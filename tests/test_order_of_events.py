"""Ranks of ramps don't hang on the order in which an hour's events are read."""

import datetime

from lacunae.operators import grid
from lacunae.plans import inference


def test_mean_in_order_of_ids(spark):
    values = [0.1, 0.2, 0.3, 1e16, -1e16, 0.7]
    want = 0.0
    for v in values:
        want += v
    for turn in range(len(values)):
        rows = [("s", 60 * k, v, k) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows[turn:] + rows[:turn], "series_id string, t bigint, v double, event_id bigint").repartition(3)
        got = grid.resample(df, 3600, order="event_id").collect()
        assert [tuple(r) for r in got] == [("s", 0, want / len(values))]


def test_query_equals_itself(spark, tmp_path):
    """Ramps before gaps are 0.2; those of baseline windows are means of 0.1, 0.2 and 0.3, above or below 0.2 by a last bit, as they are added."""
    start, rows = datetime.datetime(2024, 1, 1), []
    for hour in (h for h in range(40 * 30) if h % 30 < 26):
        values = (0.1, 0.2, 0.3) if hour % 2 else (0.0, 0.0, 0.0)
        if hour % 30 >= 18 and hour % 2:
            values = (0.2,)
        rows += [(start + datetime.timedelta(hours=hour, minutes=k), "a", v) for k, v in enumerate(values)]
    made = []
    for turn, order in enumerate((rows, rows[::-1])):
        place = {r[0]: k for k, r in enumerate(rows)}
        df = spark.createDataFrame([(place[r[0]], r[0], 1, r[1], r[2]) for r in order], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
        df.coalesce(1).write.parquet(f"{tmp_path}/{turn}/events.parquet")
        made.append(sorted(map(tuple, inference.gap_context_tests(spark, f"{tmp_path}/{turn}").collect())))
    assert made[0] and all(m == made[0] for m in made)
