"""The canonical relations as views of the star-schema tables, so that every query runs without market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import announced, reaction_day


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity 'ALL', d, close: mean order value of a day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.lit("ALL").alias("entity"), F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("close"))


def panel_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("close"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, views: quantity shipped on a day."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("views"))


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.concat("l_returnflag", "l_linestatus").alias("page"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("views"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, t (UTC wall time), close, event_id (breaks ties)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), F.col("ts").alias("t"), F.col("value").alias("close"), "event_id")


def pseudo_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity 'ALL', d, five ordering columns, close."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.lit("ALL").alias("entity"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("close"))


PSEUDO_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "close")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, raw: a sparse, deterministic choice of shipments at made-up hours."""
    x = table(spark, sf_dir, "lineitem").where("l_orderkey % 97 = 0")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").select("o_orderkey", "o_orderpriority")
    hour = F.lpad(F.pmod(F.col("l_linenumber") * 5, F.lit(24)).cast("string"), 2, "0")
    raw = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" "), hour, F.lit(":00:00-05:00"))
    return x.join(o, x.l_orderkey == o.o_orderkey).select(F.col("o_orderpriority").alias("entity"), raw.alias("raw"))


def reaction_dates(announcements: DataFrame) -> DataFrame:
    return announcements.select("entity", reaction_day(announced(F.col("raw"))).alias("d"))
