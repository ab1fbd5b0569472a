"""Feature tables of the daily and intraday studies; every feature is strictly lagged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floored_ln_abs, positive_ln, weekday_dummy
from .timeseries import demean_cross_section, log_return, rolling_mean, rolling_std, series

ATTENTION = ("views_l1", "views_l2")
RICH = ("views_ma5_l1", "views_z_l1")
DAILY = ("rv5_l1", "rv22_l1", "absret_l1")
INTRADAY = ("rv_d_l1", "rv_w_l1", "rv_m_l1")
WEEKDAYS = ("dow_1", "dow_2", "dow_3", "dow_4")


def _views(df: DataFrame, w, rich: bool) -> DataFrame:
    df = df.withColumn("dv", log_return(F.col("views"), w))
    df = df.withColumns({"views_l1": F.lag("dv").over(w), "views_l2": F.lag("dv", 2).over(w)})
    if rich:
        v = positive_ln(F.col("views"))
        df = df.withColumns({"_ma5": rolling_mean(F.col("dv"), 5, w), "_m60": rolling_mean(v, 60, w), "_s60": rolling_std(v, 60, w)})
        df = df.withColumn("_z", F.try_divide(v - F.col("_m60"), F.col("_s60")))
        df = df.withColumns({"views_ma5_l1": F.lag("_ma5").over(w), "views_z_l1": F.lag("_z").over(w)}).drop("_ma5", "_m60", "_s60", "_z")
    return df.drop("dv")


def har_daily(prices_views: DataFrame, keys: Sequence[str] = ("entity",), rich: bool = False) -> DataFrame:
    """keys, d, y and the lagged features from (keys, d, close, views); rows with a null feature go."""
    w = series(keys)
    df = prices_views.withColumn("r", log_return(F.col("close"), w))
    df = df.withColumns({"_rv5": positive_ln(rolling_std(F.col("r"), 5, w)), "_rv22": positive_ln(rolling_std(F.col("r"), 22, w)), "_abs": floored_ln_abs(F.col("r"))})
    df = df.withColumns({"y": F.col("_rv5"), "rv5_l1": F.lag("_rv5").over(w), "rv22_l1": F.lag("_rv22").over(w), "absret_l1": F.lag("_abs").over(w)})
    names = [*DAILY, *ATTENTION, *(RICH if rich else ())]
    return _views(df, w, rich).select(*keys, "d", "y", *names).na.drop(subset=["y", *names])


def har_intraday(rv_views: DataFrame, keys: Sequence[str] = ("entity",), rich: bool = False, flags: Sequence[str] = ()) -> DataFrame:
    """keys, d, y, lagged log realized variances and weekday dummies from (keys, d, rv, views); days without variance go before any lag."""
    w = series(keys)
    df = rv_views.where("rv > 0")
    df = df.withColumns({"_w": positive_ln(rolling_mean(F.col("rv"), 5, w)), "_m": positive_ln(rolling_mean(F.col("rv"), 22, w)), "y": F.ln("rv")})
    df = df.withColumns({"rv_d_l1": F.lag("y").over(w), "rv_w_l1": F.lag("_w").over(w), "rv_m_l1": F.lag("_m").over(w)})
    df = df.withColumns({f"dow_{k}": weekday_dummy(F.col("d"), k) for k in (1, 2, 3, 4)})
    names = [*INTRADAY, *ATTENTION, *WEEKDAYS, *(RICH if rich else ())]
    return _views(df, w, rich).select(*keys, "d", "y", *names, *flags).na.drop(subset=["y", *names])


def idiosyncratic(features: DataFrame, by: Sequence[str] = ("d",), names: Sequence[str] = ATTENTION) -> DataFrame:
    """Attention less its cross-section mean of the day: the one shuffle from series to dates."""
    return features.withColumns({c: demean_cross_section(F.col(c), by) for c in names})
