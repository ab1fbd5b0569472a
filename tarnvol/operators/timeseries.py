"""Positional time-series operators as window expressions.

A series is the rows of equal ``keys`` in order of ``order``; every operator takes
that pair explicitly, and all of one study share one window specification, so
Spark sorts and shuffles a series once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import positive_ln


def series(keys: Sequence[str], order: str | Sequence[str] = "d") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def log_return(x: Column, w: WindowSpec) -> Column:
    """Difference of logarithms to the row before."""
    y = positive_ln(x)
    return y - F.lag(y).over(w)


def _full(x: Column, value, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, value(x).over(frame))


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    """Sample deviation of the last ``n`` rows; null until all of them have a value."""
    return _full(x, F.stddev_samp, n, w)


def rolling_mean(x: Column, n: int, w: WindowSpec) -> Column:
    return _full(x, F.avg, n, w)


def expanding_mean_before(y: Column, w: WindowSpec) -> Column:
    """Mean of all earlier rows; the first row has itself."""
    return F.coalesce(F.avg(y).over(w.rowsBetween(Window.unboundedPreceding, -1)), y)


def event_window(flag: Column, after: int, w: WindowSpec) -> Column:
    """True on an event row and on the ``after`` rows behind it."""
    return F.coalesce(F.max(flag).over(w.rowsBetween(-after, 0)), F.lit(False))


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def align(days: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Another series on the days of the first; differences are taken afterwards, so a Monday spans the weekend."""
    return days.join(other, list(on), "left")


def next_day(events: DataFrame, days: DataFrame, keys: Sequence[str], day: str = "d", drop_before_start: bool = False) -> DataFrame:
    """Forward as-of join: each event's first calendar day on or after its own; distinct (keys, d).

    One union, one sort and a look ahead: linear in both sides, where an inequality
    join would be quadratic.  Events after the last day have none and go; events before
    the first day fall on it unless ``drop_before_start``.
    """
    keys = list(keys)
    both = days.select(*keys, day).distinct().withColumn("_day", F.col(day)).unionByName(events.select(*keys, day).withColumn("_day", F.lit(None).cast("date")))
    w = Window.partitionBy(*keys).orderBy(day, F.col("_day").isNotNull())
    ahead = F.first("_day", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    first = F.min("_day").over(Window.partitionBy(*keys))
    found = both.withColumn("_next", ahead).withColumn("_first", first).where(F.col("_day").isNull() & F.col("_next").isNotNull())
    if drop_before_start:
        found = found.where(F.col(day) >= F.col("_first"))
    return found.select(*keys, F.col("_next").alias(day)).distinct()


def demean_cross_section(x: Column, by: Sequence[str]) -> Column:
    """Minus the unweighted mean of all series present that day, itself included."""
    return x - F.avg(x).over(Window.partitionBy(*by))


def business_days(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d")).where(F.weekday("d") < 5)
