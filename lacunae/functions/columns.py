"""Column expressions that the series operators share. Times are whole seconds since 1970 (bigint), values doubles."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


#: Columns that name a series, where a call doesn't give others.
KEYS = ["series_id"]


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def floor_to(t: Column, step: int) -> Column:
    """The start of the left-closed bin of t."""
    return t - F.pmod(t, F.lit(step))


def snap(t: Column, step: int) -> Column:
    """The nearest grid point; of two equally near ones the even multiple."""
    return (F.bround(t / F.lit(step)) * F.lit(step)).cast("bigint")


def hour_of(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(86400)) / 3600).cast("int")


def in_order(keys: list[str], t: str = "t") -> Window:
    return Window.partitionBy(*keys).orderBy(t)


def last_rows(keys: list[str], n: int, t: str = "t") -> Window:
    """The current row and the n - 1 before it."""
    return in_order(keys, t).rowsBetween(-(n - 1), 0)


def so_far(keys: list[str], t: str = "t") -> Window:
    return in_order(keys, t).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, over: Window, n: int, of: Column) -> Column:
    """A frame's value, null until the frame holds n values."""
    return F.when(F.count(of).over(over) == n, value)


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def skill(model_sq: Column, reference_sq: Column) -> Column:
    """Percent by which the model's RMSE is below the reference's, from sums of squares; null where that is 0."""
    return F.when(reference_sq > 0, 100 * (1 - F.sqrt(model_sq / reference_sq)))
