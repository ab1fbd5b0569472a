"""Realized variance from bars: session filter, subsampling grids, signature curve."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import new_york, positive_ln


def regular_session(bars: DataFrame, opens: str = "09:30:00", last: str = "15:59:00") -> DataFrame:
    """Bars that begin in the New York session, both ends included to the second; adds ``t_ny`` and its day ``d``."""
    local = bars.withColumn("t_ny", new_york(F.col("t")))
    return local.where(F.date_format("t_ny", "HH:mm:ss").between(opens, last)).withColumn("d", F.to_date("t_ny"))


def daily_rv(bars: DataFrame, k: int = 1, order: Sequence[str] = ("t",), min_returns: int = 10, count_on: str = "first") -> DataFrame:
    """entity, d, rv, n: sum of squared returns on every ``k``-th bar, averaged over the ``k`` grids.

    A day stays with ``min_returns`` returns on the first grid; ``count_on="base"``
    counts them before thinning.  The first bar of a day has no return, so the night
    is left out.  One shuffle by (entity, d) serves numbering, lags and sums.
    """
    day = Window.partitionBy("entity", "d").orderBy(*order)
    grid = Window.partitionBy("entity", "d", "grid").orderBy(*order)
    y = positive_ln(F.col("close"))
    numbered = bars.select("entity", "d", *[c for c in order if c not in ("entity", "d")], "close").withColumn("grid", (F.row_number().over(day) - 1) % k)
    r = y - F.lag(y).over(grid)
    base = y - F.lag(y).over(day)
    returns = numbered.withColumn("r", r).withColumn("r1", base)
    each = returns.groupBy("entity", "d", "grid").agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.count("r").alias("c"), F.count("r1").alias("c1"))
    count = F.max(F.when(F.col("grid") == 0, F.col("c"))) if count_on == "first" else F.sum("c1")
    return each.groupBy("entity", "d").agg(F.avg("s").alias("rv"), count.alias("n")).where((F.col("n") >= min_returns) & F.col("rv").isNotNull())


def signature_curve(bars: DataFrame, steps: Iterable[int], **options) -> DataFrame:
    """entity, k, days and mean realized variance for each sampling step."""
    out = None
    for k in steps:
        one = daily_rv(bars, k, **options).groupBy("entity").agg(F.lit(k).alias("k"), F.count("*").alias("days"), F.avg("rv").alias("mean_rv"))
        out = one if out is None else out.unionByName(one)
    return out
