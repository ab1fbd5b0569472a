"""Forecast comparison and multiple testing: HAC means, DM, Clark-West, Holm, unit roots, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import norm_sf
from .timeseries import expanding_mean_before, series

LAGS = 5


def hac_mean_test(df: DataFrame, value: str, keys: Sequence[str], order: str | Sequence[str] = "d", lags: int = LAGS) -> DataFrame:
    """keys, n, mean, se, stat, p: one-sided test of a positive mean, Bartlett weights, standard normal.

    Lags run along the rows that are there, nulls left out first.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    if lags:
        rows, total = _lag_products(known, value, keys, Window.partitionBy(*keys), order, lags)
    else:  # no order is needed: plain sums, added up before the shuffle even if one key has all rows
        rows, total = known, F.var_pop(value) * F.count(value)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), total.alias("_s"))
    out = out.withColumn("se", _hac_error(F.col("_s"), F.col("n")))
    return out.withColumn("stat", F.col("mean") / F.col("se")).withColumn("p", norm_sf(F.col("stat"))).drop("_s")


def _lag_products(rows: DataFrame, value: str, keys: Sequence[str], part: WindowSpec, order: str | Sequence[str], lags: int) -> tuple[DataFrame, Column]:
    """Rows with the deviations of ``value`` and their lags in ``part``, and the aggregate of their weighted products."""
    own = f"_{value}"
    w = part.orderBy(*([order] if isinstance(order, str) else order))
    e = F.col(own)
    rows = rows.withColumn(own, F.col(value) - F.avg(value).over(part))
    rows = rows.withColumns({f"{own}{k}": F.lag(e, k).over(w) for k in range(1, lags + 1)})
    total = F.sum(e * e)
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(e * F.col(f"{own}{k}")), F.lit(0.0))
    return rows, total


def _hac_error(total: Column, n: Column) -> Column:
    return F.when(total > 0, F.sqrt(total) / n)


def with_losses(forecasts: DataFrame, y: str = "y") -> DataFrame:
    """Squared-error differential ``d_loss`` and its Clark-West adjustment ``cw_loss``."""
    eb, ea = F.col(y) - F.col("yhat_base"), F.col(y) - F.col("yhat_alt")
    gap = F.col("yhat_base") - F.col("yhat_alt")
    return forecasts.withColumns({"e2_base": eb * eb, "e2_alt": ea * ea, "d_loss": eb * eb - ea * ea, "cw_loss": eb * eb - (ea * ea - gap * gap)})


def compare(forecasts: DataFrame, keys: Sequence[str], order: str = "d", y: str = "y", lags: int = LAGS) -> DataFrame:
    """keys, n_oos, r2_oos_baseline, r2_oos_gain, r2_gain_se, dm_stat, p_dm, cw_stat, p_cw.

    Benchmark, both losses' lags and all sums are windows and one aggregation over the same partitioning.
    """
    keys = list(keys)
    rows = with_losses(forecasts, y)
    rows = rows.withColumn("_bench", expanding_mean_before(F.col(y), series(keys, order)))
    gap = F.col(y) - F.col("_bench")
    # Lags run along the rows that have losses; the two losses are null together.
    part = Window.partitionBy(*keys, F.col("d_loss").isNull())
    sums = []
    for loss in ("d_loss", "cw_loss"):
        rows, total = _lag_products(rows, loss, keys, part, order, lags)
        sums += [total.alias(f"_s_{loss}"), F.avg(loss).alias(f"_m_{loss}")]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_oos"), F.count("d_loss").alias("_n"), F.sum("e2_base").alias("_b"), F.sum("e2_alt").alias("_a"), F.sum(gap * gap).alias("_t"), F.avg("e2_base").alias("_m"), *sums).where("_n > 0")
    out = out.withColumns({f"_e_{loss}": _hac_error(F.col(f"_s_{loss}"), F.col("_n")) for loss in ("d_loss", "cw_loss")})
    out = out.withColumns({"dm_stat": F.col("_m_d_loss") / F.col("_e_d_loss"), "cw_stat": F.col("_m_cw_loss") / F.col("_e_cw_loss")})
    return out.select(
        *keys, "n_oos", (1 - F.try_divide(F.col("_b"), F.col("_t"))).alias("r2_oos_baseline"), (1 - F.try_divide(F.col("_a"), F.col("_b"))).alias("r2_oos_gain"),
        F.try_divide(F.col("_e_d_loss"), F.col("_m")).alias("r2_gain_se"), "dm_stat", norm_sf(F.col("dm_stat")).alias("p_dm"), "cw_stat", norm_sf(F.col("cw_stat")).alias("p_cw"),
    )


def holm(df: DataFrame, p: str, family: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Step-down adjusted p of each family; null p stay null and do not count.  Families are small, already aggregated tables."""
    out = out or f"{p}_holm"
    by = list(family) or [F.lit(1)]
    rank = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*by))
    stepped = df.withColumn("_step", F.when(F.col(p).isNotNull(), (m - F.row_number().over(rank) + 1) * F.col(p)))
    worst = F.max("_step").over(rank.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), worst))).drop("_step")


def pooled_mean(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean of ``value`` over all series for each date or week."""
    return rows.groupBy(*by).agg(F.avg(value).alias(value), F.count(value).alias("members"))


def iso_week(d: Column) -> tuple[Column, Column]:
    return F.extract(F.lit("YEAROFWEEK"), d).alias("iso_year"), F.weekofyear(d).alias("iso_week")


def week_clustered(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    year, week = iso_week(F.col("d"))
    return rows.withColumns({"iso_year": year, "iso_week": week}).groupBy(*keys, "iso_year", "iso_week").agg(F.avg(value).alias(value), F.count(value).alias("members"))


def autocorrelation(df: DataFrame, value: str, keys: Sequence[str], lags: int = 40, order: str = "d") -> DataFrame:
    """keys, lag, acf for lags 0..``lags``."""
    keys = list(keys)
    w = series(keys, order)
    rows = df.where(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    sums = [F.sum(F.col("_e") * F.col("_e")).alias("_s0")]
    rows = rows.withColumns({f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    sums += [F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, lags + 1)]
    wide = rows.groupBy(*keys).agg(*sums)
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_s{k}"), F.col("_s0")).alias("acf")) for k in range(lags + 1))))
    return wide.select(*keys, stacked.alias("x")).select(*keys, "x.lag", "x.acf")


def cross_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str], first: int = -5, last: int = 10, order: str = "d") -> DataFrame:
    """keys, lag, ccf: correlation of y(t) with x(t - lag); negative lags look ahead."""
    keys = list(keys)
    w = series(keys, order)
    shifts = range(first, last + 1)
    rows = df.withColumns({f"_x{i}": F.lag(x, k).over(w) if k >= 0 else F.lead(x, -k).over(w) for i, k in enumerate(shifts)})
    wide = rows.groupBy(*keys).agg(*(F.corr(F.col(f"_x{i}"), F.col(y)).alias(f"_c{i}") for i, _ in enumerate(shifts)))
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_c{i}").alias("ccf")) for i, k in enumerate(shifts))))
    return wide.select(*keys, stacked.alias("z")).select(*keys, "z.lag", "z.ccf")


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    rss = float(e @ e)
    var = rss / max(1, len(y) - x.shape[1]) * np.linalg.pinv(x.T @ x)
    return beta, np.sqrt(np.diag(var)), rss


def adf_statistic(x: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller with a constant: statistic, p and lag order by AIC on a common sample."""
    x = np.asarray(x, float)
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    dx = np.diff(x)

    def design(lags: int, drop: int):
        rows = np.arange(drop, len(dx))
        return np.column_stack([x[rows], *(dx[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))]), dx[rows]

    scores = []
    for lags in range(most + 1):
        a, b = design(lags, most)
        _, _, rss = _ols(a, b)
        m = len(b)
        scores.append(m * math.log(rss / m) + 2 * a.shape[1])
    lags = int(np.argmin(scores))
    beta, se, _ = _ols(*design(lags, lags))
    tau = float(beta[0] / se[0])
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    # MacKinnon's response surface, one variable, constant.
    if tau > 2.74:
        p = 1.0
    elif tau < -18.83:
        p = 0.0
    elif tau <= -1.61:
        p = phi(2.1659 + 1.4412 * tau + 0.038269 * tau**2)
    else:
        p = phi(1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3)
    return tau, p, lags


def adf_test(df: DataFrame, value: str, keys: Sequence[str], order: str = "d") -> DataFrame:
    keys = list(keys)
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "n long, adf_stat double, adf_p double, adf_lags int"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(order)[value].to_numpy(float)
        stat, p, lags = adf_statistic(x) if len(x) > 20 and np.ptp(x) > 0 else (None, None, None)
        return pd.DataFrame([[*(part[k].iloc[0] for k in keys), len(x), stat, p, lags]], columns=[*keys, "n", "adf_stat", "adf_p", "adf_lags"])

    return df.where(F.col(value).isNotNull()).select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)
