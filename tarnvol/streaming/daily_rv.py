"""Daily realized variance of a bar stream: one-day windows with a watermark for late bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import positive_ln


def streaming_rv(bars: DataFrame, late: str = "1 hour") -> DataFrame:
    """entity, day, rv, n from (entity, t TIMESTAMP, close): the day's closes are sorted by time when its window is done."""
    day = bars.withWatermark("t", late).groupBy("entity", F.window("t", "1 day").alias("w")).agg(F.array_sort(F.collect_list(F.struct("t", positive_ln(F.col("close")).alias("y")))).alias("b"))
    r = F.zip_with(F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))), F.slice("b", 1, F.greatest(F.size("b") - 1, F.lit(0))), lambda a, b: a["y"] - b["y"])
    kept = F.filter(r, lambda x: x.isNotNull())
    return day.select("entity", F.to_date("w.start").alias("day"), F.aggregate(kept, F.lit(0.0), lambda s, x: s + x * x).alias("rv"), F.size(kept).alias("n"))
