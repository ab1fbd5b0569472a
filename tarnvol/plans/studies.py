"""The studies end to end: one lazy plan over all series, keyed by entity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import ATTENTION, DAILY, INTRADAY, RICH, WEEKDAYS, har_daily, har_intraday, idiosyncratic
from ..operators.inference import adf_test, compare, hac_mean_test, holm, iso_week, pooled_mean, week_clustered, with_losses
from ..operators.timeseries import event_window, next_day, series
from ..operators.walkforward import MIN_TRAIN, REFIT, REFIT_TREES, first_window_coefficient, walk_forward_ols, walk_forward_trees
from . import universe


def pairs_relation(spark: SparkSession, name: str) -> DataFrame:
    """ord, target, page, company: list order made explicit."""
    rows = {"daily": universe.DAILY_PAIRS, "panel": universe.PANEL_PAIRS, "stocks": universe.STOCKS, "candidates": universe.CANDIDATES}[name]
    return spark.createDataFrame([(i, r[0], r[1], r[2] if len(r) > 2 else None) for i, r in enumerate(rows)], "ord int, target string, page string, company string")


def spec_grid(spark: SparkSession) -> DataFrame:
    """Pairs x models x weekday flags; literal and bounded."""
    models = spark.createDataFrame([("ols",), ("gbm",)], "model string")
    flags = spark.createDataFrame([(False,), (True,)], "dow boolean")
    return pairs_relation(spark, "daily").select("target", "page").crossJoin(models).crossJoin(flags)


def daily_study(prices_views: DataFrame, keys: Sequence[str] = ("entity",), min_train: int = MIN_TRAIN, refit: int = REFIT) -> DataFrame:
    """Features, nested forecasts, DM and Clark-West with Holm over all pairs, unit roots, burn-in coefficient."""
    keys = list(keys)
    f = har_daily(prices_views, keys)
    out = compare(walk_forward_ols(f, keys, DAILY, [*DAILY, *ATTENTION], min_train=min_train, refit=refit), keys)
    unit = adf_test(f, "y", keys).select(*keys, F.col("adf_p").alias("adf_p_y")).join(adf_test(f, "views_l1", keys).select(*keys, F.col("adf_p").alias("adf_p_views")), keys)
    coef = first_window_coefficient(f, keys, [*DAILY, *ATTENTION], "views_l1", min_train=min_train).drop("n_train")
    return holm(holm(out, "p_dm"), "p_cw").join(unit, keys).join(coef, keys)


def intraday_study(rv_views: DataFrame, keys: Sequence[str] = ("entity",), models: Sequence[str] = ("ols", "gbm"), min_train: int = MIN_TRAIN, rounds: int = 150) -> DataFrame:
    """The grid of models and weekday controls over shared features; Clark-West is blank for trees; Holm in each cell of the grid.

    The cells' forecasts are compared together, keyed by the cell: one plan of the tests, not one a cell.
    """
    keys = list(keys)
    grid = None
    for model in models:
        f = har_intraday(rv_views, keys, rich=model != "ols")
        for dow in (False, True):
            base = [*INTRADAY, *(WEEKDAYS if dow else ())]
            alt = [*base, *ATTENTION, *(RICH if model != "ols" else ())]
            fc = walk_forward_ols(f, keys, base, alt, min_train=min_train) if model == "ols" else walk_forward_trees(f, keys, base, alt, min_train=min_train, refit=REFIT_TREES, rounds=rounds)
            one = fc.select(*keys, "d", "y", "yhat_base", "yhat_alt", F.lit(model).alias("model"), F.lit(dow).alias("dow"))
            grid = one if grid is None else grid.unionByName(one)
    cell = [*keys, "model", "dow"]
    out = compare(grid, cell)
    out = out.select(*keys, *(c for c in out.columns if c not in cell), "model", "dow")
    for c in ("cw_stat", "p_cw"):
        out = out.withColumn(c, F.when(F.col("model") != "gbm", F.col(c)))
    return holm(holm(out, "p_dm", ("model", "dow")), "p_cw", ("model", "dow"))


def mark_events(features: DataFrame, reactions: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """``earn`` on the first row on or after a reaction date, ``earn3`` there and two rows on."""
    keys = list(keys)
    hit = next_day(reactions, features.select(*keys, "d"), keys).withColumn("earn", F.lit(True))
    marked = features.join(hit, [*keys, "d"], "left").withColumn("earn", F.coalesce("earn", F.lit(False)))
    return marked.withColumn("earn3", event_window(F.col("earn"), 2, series(keys)))


def rv_ratio(marked: DataFrame, keys: Sequence[str] = ("entity",), y: str = "y") -> DataFrame:
    """Mean variance of event days over other days (geometric), on all feature rows."""
    return marked.groupBy(*keys).agg(F.count_if("earn").alias("n_earn"), F.exp(F.avg(F.when(F.col("earn"), F.col(y))) - F.avg(F.when(~F.col("earn"), F.col(y)))).alias("earn_rv_ratio"))


def event_compare(forecasts: DataFrame, flag: str, prefix: str, keys: Sequence[str] = ("entity",), least: int = 10) -> DataFrame:
    """``compare`` on flagged rows, lags along the flagged sequence; null below ``least`` rows."""
    keys = list(keys)
    only = compare(forecasts.where(F.col(flag)), keys).withColumnRenamed("n_oos", f"n_{prefix}")
    ok = F.col(f"n_{prefix}") >= least
    names = {"r2_oos_gain": f"{prefix}_r2_gain", "r2_gain_se": f"{prefix}_r2_se", "cw_stat": f"{prefix}_cw_stat", "p_cw": f"{prefix}_p_cw"}
    return only.select(*keys, f"n_{prefix}", *(F.when(ok, F.col(a)).alias(b) for a, b in names.items()))


def in_range(rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first:
        rows = rows.where(F.col("d") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("d") <= F.lit(last).cast("date"))
    return rows


def panel_study(marked: DataFrame, keys: Sequence[str], base: Sequence[str], attention: Sequence[str] = ATTENTION, min_train: int = MIN_TRAIN) -> tuple[DataFrame, DataFrame]:
    """Rows a series (with event statistics and Holm), and the pooled test over dates."""
    keys = list(keys)
    base = [*base, "earn"]  # without a company no row is flagged, and the coefficient is 0
    fc = walk_forward_ols(marked, keys, base, [*base, *attention], min_train=min_train)
    rows = compare(fc, keys).join(event_compare(fc, "earn", "earn", keys), keys, "left")
    rows = holm(holm(rows, "p_cw"), "earn_p_cw")
    pooled = hac_mean_test(pooled_mean(with_losses(fc), "cw_loss", ["d"]).withColumn("test", F.lit("pooled_cw")), "cw_loss", ["test"]).select("test", "n", "stat", "p")
    return rows, pooled


def stock_study(marked: DataFrame, base: Sequence[str], idio: bool, keys: Sequence[str] = ("entity",), min_train: int = MIN_TRAIN) -> tuple[DataFrame, DataFrame]:
    """Single stocks with raw or idiosyncratic attention; pooled, event-stacked and week-clustered tests."""
    keys = list(keys)
    f = idiosyncratic(marked) if idio else marked
    base = [*base, "earn"]
    fc = walk_forward_ols(f, keys, base, [*base, *ATTENTION], min_train=min_train)
    rows = compare(fc, keys).join(rv_ratio(f, keys).drop("n_earn"), keys).join(event_compare(fc, "earn", "earn1", keys), keys, "left").join(event_compare(fc, "earn3", "earn3", keys), keys, "left")
    for p in ("p_cw", "earn1_p_cw", "earn3_p_cw"):
        rows = holm(rows, p)
    return rows, pooled_tests(fc, keys)


def pooled_tests(fc: DataFrame, keys: Sequence[str]) -> DataFrame:
    losses = with_losses(fc)
    out = hac_mean_test(pooled_mean(losses, "cw_loss", ["d"]).withColumn("test", F.lit("all_days")), "cw_loss", ["test"])
    for flag, name in (("earn", "reaction_day"), ("earn3", "three_days")):
        only = losses.where(F.col(flag))
        out = out.unionByName(hac_mean_test(only.withColumn("test", F.lit(f"{name}_stacked")), "cw_loss", ["test"], [*keys, "d"], 0))
        out = out.unionByName(hac_mean_test(week_clustered(only, "cw_loss").withColumn("test", F.lit(f"{name}_by_week")), "cw_loss", ["test"], ["iso_year", "iso_week"], 0))
    return out.select("test", "n", "stat", "p")


def reaction_test(losses: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row n_events, n_weeks, stat, p on flagged rows in the range; null statistics below three events."""
    only = in_range(losses.where(F.col("earn") & F.col("cw_loss").isNotNull()), first, last).withColumn("test", F.lit("primary"))
    year, week = iso_week(F.col("d"))
    counts = only.select("test", year, week).agg(F.count("*").alias("n_events"), F.countDistinct("iso_year", "iso_week").alias("n_weeks"))
    weekly = hac_mean_test(week_clustered(only, "cw_loss", ["test"]), "cw_loss", ["test"], ["iso_year", "iso_week"], 0)
    enough = F.col("n_events") >= 3
    joined = counts.withColumn("test", F.lit("primary")).join(weekly, "test", "left")
    return joined.select("n_events", F.when(enough, F.col("n_weeks")).otherwise(0).alias("n_weeks"), F.when(enough, F.col("stat")).alias("stat"), F.when(enough, F.col("p")).alias("p"))


def replication(marked: DataFrame, base: Sequence[str], first: str | None = None, last: str | None = None, keys: Sequence[str] = ("entity",), min_train: int = MIN_TRAIN) -> tuple[DataFrame, DataFrame]:
    """Rows a stock and the one-row verdict of the registered test."""
    keys, base = list(keys), [*base, "earn"]
    fc = walk_forward_ols(idiosyncratic(marked), keys, base, [*base, *ATTENTION], min_train=min_train)
    rows = compare(fc, keys).join(rv_ratio(marked, keys).drop("n_earn"), keys).join(event_compare(fc, "earn", "earn1", keys), keys, "left")
    rows = holm(rows, "earn1_p_cw")
    gains = rows.agg(F.avg("earn1_r2_gain").alias("mean_stock_r2_gain"), F.count_if(F.col("earn1_r2_gain") > 0).alias("n_stocks_positive"), F.count("earn1_p_cw").alias("n_stocks"))
    primary = reaction_test(with_losses(fc), first, last).crossJoin(gains)  # one row by one row
    return rows, primary.withColumn("success", F.coalesce((F.col("p") < universe.ALPHA) & (F.col("mean_stock_r2_gain") > 0), F.lit(False)))


def select_sample(candidates: DataFrame, excluded: Sequence[str] = (), size: int = universe.SAMPLE_SIZE) -> DataFrame:
    """The first ``size`` candidates in list order that are not excluded."""
    spark = candidates.sparkSession
    out = spark.createDataFrame([(t,) for t in excluded], "target string")
    return candidates.join(out, "target", "left_anti").orderBy("ord").limit(size)


def exclusion_rules(stats: DataFrame) -> DataFrame:
    """First rule that excludes an entity from (zero_view_days, n_events, earn_rv_ratio, missing_share), or null."""
    rule = F.when(F.col("zero_view_days") > 0, "zero_view_days").when(F.col("n_events") < universe.MIN_EVENTS, "few_events")
    rule = rule.when(F.coalesce(F.col("earn_rv_ratio") < universe.MIN_RV_RATIO, F.lit(True)), "rv_ratio").when(F.col("missing_share") > universe.MAX_MISSING, "missing_bars")
    return stats.withColumn("excluded_by", rule)


def refuse_before(sample: str, allow_early: bool = False, today: dt.date | None = None) -> None:
    """The registered sample may not be run before its date."""
    if (today or dt.date.today()) < dt.date.fromisoformat(universe.EARLIEST_RUN[sample]) and not allow_early:
        raise SystemExit(f"sample '{sample}' may be run from {universe.EARLIEST_RUN[sample]} on")
