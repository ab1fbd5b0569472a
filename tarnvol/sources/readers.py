"""Readers of the canonical relations from files, a read-through landing table, and a paged HTTP source."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PRICES = "entity string, d date, close double"
VIEWS = "page string, d date, views bigint"
BARS = "entity string, t timestamp_ntz, close double"
ANNOUNCEMENTS = "entity string, raw string"
#: Waits before each attempt, in seconds.
BACK_OFF = (0, 5, 15, 40, 90)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily closes from Parquet, other columns pruned at the scan."""
    return spark.read.parquet(path).select("entity", F.col("d").cast("date").alias("d"), F.col("close").cast("double").alias("close"))


def read_views_json(spark: SparkSession, path: str) -> DataFrame:
    """Page views from the REST payload: ``items[].timestamp`` (its first eight digits) and ``items[].views``."""
    payload = "items array<struct<article:string,timestamp:string,views:bigint>>"
    item = spark.read.schema(payload).option("multiLine", True).json(path).select(F.explode("items").alias("i"))
    return item.select(F.col("i.article").alias("page"), F.to_date(F.substring("i.timestamp", 1, 8), "yyyyMMdd").alias("d"), F.col("i.views").alias("views"))


def read_bars_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars from stored result pages: ``bars[].t``, ``bars[].c``."""
    payload = "symbol string, bars array<struct<t:string,c:double>>, next_page_token string"
    bar = spark.read.schema(payload).option("multiLine", True).json(path).select("symbol", F.explode("bars").alias("b"))
    return bar.select(F.col("symbol").alias("entity"), F.to_timestamp_ntz(F.substring("b.t", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("t"), F.col("b.c").alias("close"))


def read_announcements(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ANNOUNCEMENTS)


def credentials(*names: str) -> list[str]:
    """Values of environment variables the user names; an error if one is missing."""
    missing = [n for n in names if not os.environ.get(n)]
    if missing:
        raise RuntimeError(f"set {', '.join(missing)} in the environment")
    return [os.environ[n] for n in names]


def with_retry(call: Callable[[], tuple[int, bytes]], waits: Sequence[float] = BACK_OFF, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Repeat a request while it answers 429; any other failure is raised at once."""
    status = 0
    for wait in waits:
        sleep(wait)
        status, body = call()
        if status != 429:
            break
    if status >= 400:
        raise RuntimeError(f"HTTP status {status}")
    return body


def pages(fetch: Callable[[str | None], dict], items: str, token: str = "next_page_token") -> Iterator[dict]:
    """Rows of all result pages, following the token until there is none."""
    mark = None
    while True:
        page = fetch(mark)
        yield from page.get(items) or []
        mark = page.get(token)
        if not mark:
            return


class BarsSource(DataSource):
    """``spark.read.format("paged_bars")``: one partition for each symbol; options url, symbols, headers by environment."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return _BarsReader(dict(self.options))


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class _BarsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.options["symbols"].split(",") if s]

    def read(self, partition: _Symbol):
        import datetime as dt
        import json
        import urllib.error
        import urllib.parse
        import urllib.request

        o = self.options
        headers = {}
        if o.get("header_names") and o.get("header_variables"):
            headers = dict(zip(o["header_names"].split(","), credentials(*o["header_variables"].split(",")), strict=True))
        fixed = {k: o[k] for k in ("timeframe", "start", "end", "feed", "adjustment", "limit") if k in o}

        def page(mark: str | None) -> dict:
            query = urllib.parse.urlencode(fixed | ({"page_token": mark} if mark else {}))

            def call() -> tuple[int, bytes]:
                try:
                    with urllib.request.urlopen(urllib.request.Request(f"{o['url'].format(partition.symbol)}?{query}", headers=headers), timeout=60) as r:
                        return r.status, r.read()
                except urllib.error.HTTPError as e:
                    return e.code, b""

            return json.loads(with_retry(call))

        for bar in pages(page, "bars"):
            yield partition.symbol, dt.datetime.fromisoformat(bar["t"][:19]), float(bar["c"])


def landed(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read-through cache: the table at ``path`` if it is complete, else ``build()`` written there once."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
