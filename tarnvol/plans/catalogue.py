"""One query for each operator over the bound tables, with the SQL that an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import NORMAL_DENOMINATOR, NORMAL_NUMERATOR, NORMAL_SPLIT, ROOT_TWO_PI, norm_cdf, positive_ln, weekday_dummy
from ..operators import features as feats
from ..operators import inference as inf
from ..operators import realized as rv
from ..operators import timeseries as ts
from ..operators import walkforward as wf
from ..session import ship
from ..sources import bindings as b
from ..sources.sinks import confidence_bounds
from . import simulation, studies, universe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["entity"]
PLACES = 6
#: The page of each panel entity.
PAGES = {"1-URGENT": "AF", "2-HIGH": "NF", "3-MEDIUM": "NO", "4-NOT SPECIFIED": "RF", "5-LOW": "AO"}


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, PLACES).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "smallint", "tinyint") else F.col(c) for c, k in df.dtypes))


def query(sql: str | None = None, doubles: str = "", others: str = ""):
    """Register a query; ``sql`` ends in a relation ``out`` of which ``others`` and the rounded ``doubles`` are compared."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return tidy(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            shown = [*others.split(), *(f"round({c}, {PLACES}) AS {c}" for c in doubles.split())]
            ORACLES[f.__name__] = f"WITH {sql.strip().rstrip(',')} SELECT {', '.join(shown)} FROM out"
        return f

    return add


# --- SQL parts -------------------------------------------------------------

PRICES = "prices AS (SELECT 'ALL' AS entity, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS close FROM orders GROUP BY 2),"
PANEL = "panel AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2),"
VIEWS = "views AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS views FROM lineitem GROUP BY 1),"
PAGE_VIEWS = "page_views AS (SELECT l_returnflag || l_linestatus AS page, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS views FROM lineitem GROUP BY 1, 2),"
W = "OVER (PARTITION BY entity ORDER BY d)"
JOINED = PRICES + VIEWS + "joined AS (SELECT p.*, v.views FROM prices p LEFT JOIN views v USING (d)),"
PAGE_MAP = "pairs(entity, page) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in PAGES.items()) + "),"
PANEL_JOINED = PANEL + PAGE_VIEWS + PAGE_MAP + "joined AS (SELECT p.*, v.views FROM panel p JOIN pairs USING (entity) LEFT JOIN page_views v ON v.page = pairs.page AND v.d = p.d),"


def _frame(n: int, order: str = "d") -> str:
    return f"OVER (PARTITION BY entity ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_frame(n)} = {n} THEN {f}({x}) {_frame(n)} END"


def _ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


RETURNS = f"returns AS (SELECT *, ln(close) - lag(ln(close)) {W} AS r FROM joined),"
HAR = (
    RETURNS
    + f"vols AS (SELECT *, {_full('stddev_samp', 'r', 5)} AS s5, {_full('stddev_samp', 'r', 22)} AS s22, ln(views) - lag(ln(views)) {W} AS dv FROM returns),"
    + f"logs AS (SELECT *, {_ln('s5')} AS y, {_ln('s22')} AS l22, ln(abs(r) + 1e-6) AS la FROM vols),"
    + f"""lagged AS (SELECT entity, d, y, lag(y) {W} AS rv5_l1, lag(l22) {W} AS rv22_l1, lag(la) {W} AS absret_l1,
        lag(dv) {W} AS views_l1, lag(dv, 2) {W} AS views_l2 FROM logs),
    har AS (SELECT * FROM lagged WHERE y IS NOT NULL AND rv5_l1 IS NOT NULL AND rv22_l1 IS NOT NULL AND absret_l1 IS NOT NULL AND views_l1 IS NOT NULL AND views_l2 IS NOT NULL),"""
)
HAR_COLUMNS = "y rv5_l1 rv22_l1 absret_l1 views_l1 views_l2"
SESSION = """local AS (SELECT event_type AS entity, event_id, value AS close, timezone('America/New_York', timezone('UTC', ts)) AS t_ny FROM events),
session AS (SELECT *, CAST(t_ny AS DATE) AS d FROM local WHERE strftime(t_ny, '%H:%M:%S') BETWEEN '09:30:00' AND '15:59:00'),"""
WHOLE_DAYS = "session AS (SELECT event_type AS entity, event_id, value AS close, ts AS t_ny, CAST(ts AS DATE) AS d FROM events),"


def _rv(k: int, name: str = "rv", source: str = "session", order: str = "t_ny, event_id") -> str:
    return f"""
{name}_g AS (SELECT *, (row_number() OVER (PARTITION BY entity, d ORDER BY {order}) - 1) % {k} AS grid FROM {source}),
{name}_r AS (SELECT *, {_ln('close')} - lag({_ln('close')}) OVER (PARTITION BY entity, d, grid ORDER BY {order}) AS r FROM {name}_g),
{name}_s AS (SELECT entity, d, grid, sum(r * r) AS s, count(r) AS c FROM {name}_r GROUP BY ALL),
{name} AS (SELECT entity, d, avg(s) AS rv, max(CASE WHEN grid = 0 THEN c END) AS n FROM {name}_s GROUP BY ALL HAVING max(CASE WHEN grid = 0 THEN c END) >= 10 AND avg(s) IS NOT NULL),"""


PSEUDO = "session AS (SELECT 'ALL' AS entity, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS close FROM lineitem)," + _rv(
    1, order="l_orderkey, l_linenumber, l_partkey, l_suppkey, close"
)


LOSSES = """
losses AS (SELECT *, (y - yhat_base) ** 2 AS e2_base, (y - yhat_alt) ** 2 AS e2_alt, (y - yhat_base) ** 2 - (y - yhat_alt) ** 2 AS d_loss,
    (y - yhat_base) ** 2 - ((y - yhat_alt) ** 2 - (yhat_base - yhat_alt) ** 2) AS cw_loss FROM fc),"""


def _forecasts(source: str, min_train: int = wf.MIN_TRAIN, refit: int = wf.REFIT) -> str:
    """Constant against one lag of the log level, both from earlier blocks only."""
    return f"""
levels AS (SELECT entity, d, ln(close) AS y, lag(ln(close)) {W} AS x FROM {source}),
f AS (SELECT *, row_number() {W} AS rn FROM levels WHERE x IS NOT NULL AND y IS NOT NULL),
blocks AS (SELECT *, CASE WHEN rn <= {min_train} THEN -1 ELSE (rn - 1 - {min_train}) // {refit} END AS block FROM f),
starts AS (SELECT DISTINCT entity, block FROM blocks WHERE block >= 0),
fits AS (SELECT s.entity, s.block, regr_slope(t.y, t.x) AS slope, regr_intercept(t.y, t.x) AS cut, avg(t.y) AS level
    FROM starts s JOIN f t ON t.entity = s.entity AND t.rn <= {min_train} + {refit} * s.block GROUP BY 1, 2),
fc AS (SELECT b.entity, b.d, b.rn, b.block, b.y, level AS yhat_base, cut + slope * b.x AS yhat_alt FROM blocks b JOIN fits USING (entity, block)),""" + LOSSES


def _nested(source: str, base, extra, kept=(), min_train: int = wf.MIN_TRAIN, refit: int = wf.REFIT) -> str:
    """Least squares on ``base`` and on ``base`` with ``extra``: normal equations of the rows before each block.

    One elimination serves both, as the shorter model's columns come first; a column
    without variation beside the earlier ones has coefficient 0.
    """
    z = ["1e0", *base, *extra, "y"]
    n = len(z) - 1
    sums = ", ".join([f"sum({z[i]} * {z[j]}) AS g{i}_{j}" for i in range(n) for j in range(i, n + 1)] + [f"sum({c} * {c}) AS d{i}" for i, c in enumerate(z[:n])])
    steps, last = "", "gram"
    for k in range(n):
        rest = range(k + 1, n + 1)
        steps += f"u{k} AS (SELECT *, " + ", ".join(f"CASE WHEN g{k}_{k} > {wf.RANK_TOLERANCE!r} * d{k} THEN g{k}_{j} / g{k}_{k} ELSE 0 END AS u{k}_{j}" for j in rest) + f" FROM {last}),\n"
        last = f"u{k}"
        if k < n - 1:
            steps += f"s{k} AS (SELECT * REPLACE (" + ", ".join(f"g{i}_{j} - u{k}_{i} * g{k}_{j} AS g{i}_{j}" for i in rest if i < n for j in range(i, n + 1)) + f") FROM u{k}),\n"
            last = f"s{k}"
    back = [f"u{k}_{n}" + "".join(f" - u{k}_{j} * {m}{j}" for j in range(k + 1, size)) + f" AS {m}{k}" for m, size in (("short", len(base) + 1), ("long", n)) for k in reversed(range(size))]
    yhat = lambda m, size: " + ".join(f"{m}{k} * {c}" for k, c in enumerate(z[:size]))
    return f"""
f AS (SELECT *, row_number() {W} AS rn FROM {source}),
blocks AS (SELECT *, CASE WHEN rn <= {min_train} THEN -1 ELSE (rn - 1 - {min_train}) // {refit} END AS block FROM f),
starts AS (SELECT DISTINCT entity, block FROM blocks WHERE block >= 0),
gram AS (SELECT s.entity, s.block, {sums} FROM starts s JOIN f t ON t.entity = s.entity AND t.rn <= {min_train} + {refit} * s.block GROUP BY 1, 2),
{steps}fits AS (SELECT entity, block, {', '.join(back)} FROM {last}),
fc AS (SELECT {', '.join(['entity', 'd', 'rn', 'block', 'y', *kept])}, {yhat('short', len(base) + 1)} AS yhat_base, {yhat('long', n)} AS yhat_alt FROM blocks JOIN fits USING (entity, block)),""" + LOSSES


def _number(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _poly(x: str, cs) -> str:
    out = _number(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def _sf(x: str) -> str:
    a = f"abs({x})"
    deep = f"{a} + 0.65e0"
    for k in (4, 3, 2, 1):
        deep = f"({a} + {k}e0 / ({deep}))"
    tail = f"CASE WHEN {a} < {_number(NORMAL_SPLIT)} THEN exp(-{a} * {a} / 2) * {_poly(a, NORMAL_NUMERATOR)} / {_poly(a, NORMAL_DENOMINATOR)} ELSE exp(-{a} * {a} / 2) / ({deep} * {_number(ROOT_TWO_PI)}) END"
    return f"CASE WHEN {x} > 0 THEN {tail} ELSE 1 - ({tail}) END"


def _hac(name: str, source: str, value: str, keys: str = "entity", order: str = "d", lags: int = 5) -> str:
    lag = "".join(f", lag(e, {k}) OVER (PARTITION BY {keys} ORDER BY {order}) AS e{k}" for k in range(1, lags + 1))
    s = "sum(e * e)" + "".join(f" + 2 * (1 - {k}e0 / {lags + 1}) * coalesce(sum(e * e{k}), 0)" for k in range(1, lags + 1))
    return f"""
{name}_e AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {keys}) AS e FROM {source} WHERE {value} IS NOT NULL),
{name}_l AS (SELECT *{lag} FROM {name}_e),
{name}_s AS (SELECT {keys}, count(*) AS n, avg({value}) AS mean, {s} AS s FROM {name}_l GROUP BY {keys}),
{name}_t AS (SELECT *, CASE WHEN s > 0 THEN sqrt(s) / n END AS se FROM {name}_s),
{name} AS (SELECT {keys}, n, mean, se, mean / se AS stat, {_sf('(mean / se)')} AS p FROM {name}_t),"""


REACTIONS = """raw AS (SELECT o_orderpriority AS entity, CAST(l_shipdate AS DATE) + CASE WHEN (l_linenumber * 5) % 24 >= 16 THEN 1 ELSE 0 END AS d
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 97 = 0),"""
EARN = """hits AS (SELECT DISTINCT entity, d FROM (SELECT r.entity, min(t.d) AS d FROM raw r JOIN days t ON t.entity = r.entity AND t.d >= r.d GROUP BY r.entity, r.d)),"""
MARKED = REACTIONS + "days AS (SELECT DISTINCT entity, d FROM fc)," + EARN + "marked AS (SELECT l.*, h.d IS NOT NULL AS earn FROM losses l LEFT JOIN hits h ON h.entity = l.entity AND h.d = l.d),"
CALENDAR = "days AS (SELECT entity, CAST(d AS DATE) AS d FROM (SELECT DISTINCT o_orderpriority AS entity FROM orders), (SELECT unnest(generate_series(DATE '1995-01-02', DATE '2001-07-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6),"


# --- Spark parts -----------------------------------------------------------


def joined(spark, sf):
    return ts.align(b.prices(spark, sf), b.views(spark, sf), ["d"])


def panel_joined(spark, sf):
    pages = spark.createDataFrame(list(PAGES.items()), "entity string, page string")
    return ts.align(b.panel_prices(spark, sf).join(F.broadcast(pages), "entity"), b.page_views(spark, sf), ["page", "d"]).drop("page")  # a literal of five rows


def levels(prices: DataFrame) -> DataFrame:
    w = ts.series(KEYS)
    y = positive_ln(F.col("close"))
    return prices.select("entity", "d", y.alias("y"), F.lag(y).over(w).alias("x")).na.drop(subset=["x", "y"])


def one_lag(prices: DataFrame) -> DataFrame:
    return wf.walk_forward_ols(levels(prices), KEYS, [], ["x"])


def panel_losses(spark, sf):
    return inf.with_losses(one_lag(b.panel_prices(spark, sf)))


def marked_losses(spark, sf):
    rows = panel_losses(spark, sf)
    hit = ts.next_day(b.reaction_dates(b.announcements(spark, sf)), rows.select("entity", "d"), KEYS).withColumn("earn", F.lit(True))
    return rows.join(hit, ["entity", "d"], "left").withColumn("earn", F.coalesce("earn", F.lit(False)))


def pseudo_rv(spark, sf):
    return rv.daily_rv(b.pseudo_bars(spark, sf), 1, b.PSEUDO_ORDER)


def whole_days(spark, sf):
    return b.bars(spark, sf).withColumn("d", F.to_date("t"))


# --- Features and calendars ------------------------------------------------


@query(PRICES + f"out AS (SELECT entity, d, ln(close) - lag(ln(close)) {W} AS r FROM prices)", "r", "entity d")
def log_return(spark, sf):
    return b.prices(spark, sf).select("entity", "d", ts.log_return(F.col("close"), ts.series(KEYS)).alias("r"))


@query(JOINED + f"x AS (SELECT entity, d, ln(views) - lag(ln(views)) {W} AS dv FROM joined), out AS (SELECT * FROM x WHERE dv IS NOT NULL)", "dv", "entity d")
def views_aligned_change(spark, sf):
    return joined(spark, sf).select("entity", "d", ts.log_return(F.col("views"), ts.series(KEYS)).alias("dv")).na.drop(subset=["dv"])


@query(PRICES + f"joined AS (SELECT * FROM prices)," + RETURNS + f"out AS (SELECT entity, d, {_full('stddev_samp', 'r', 5)} AS s5, {_full('stddev_samp', 'r', 22)} AS s22, {_full('stddev_samp', 'r', 60)} AS s60 FROM returns)", "s5 s22 s60", "entity d")
def rolling_std_full_window(spark, sf):
    w = ts.series(KEYS)
    r = b.prices(spark, sf).withColumn("r", ts.log_return(F.col("close"), w))
    return r.select("entity", "d", *(ts.rolling_std(F.col("r"), n, w).alias(f"s{n}") for n in (5, 22, 60)))


@query(VIEWS + f"v AS (SELECT 'ALL' AS entity, * FROM views), out AS (SELECT entity, d, {_full('avg', 'views', 5)} AS m5, {_full('avg', 'views', 60)} AS m60 FROM v)", "m5 m60", "entity d")
def rolling_mean_full_window(spark, sf):
    w = ts.series(KEYS)
    return b.views(spark, sf).withColumn("entity", F.lit("ALL")).select("entity", "d", *(ts.rolling_mean(F.col("views"), n, w).alias(f"m{n}") for n in (5, 60)))


@query(JOINED + f"x AS (SELECT *, ln(close) - lag(ln(close)) {W} AS r, ln(views) - lag(ln(views)) {W} AS dv FROM joined), out AS (SELECT entity, d, lag(r) {W} AS r_l1, lag(dv) {W} AS views_l1, lag(dv, 2) {W} AS views_l2 FROM x)", "r_l1 views_l1 views_l2", "entity d")
def lagged_features(spark, sf):
    w = ts.series(KEYS)
    x = joined(spark, sf).withColumns({"r": ts.log_return(F.col("close"), w), "dv": ts.log_return(F.col("views"), w)})
    return x.select("entity", "d", F.lag("r").over(w).alias("r_l1"), F.lag("dv").over(w).alias("views_l1"), F.lag("dv", 2).over(w).alias("views_l2"))


@query(JOINED + HAR + "out AS (SELECT * FROM har)", HAR_COLUMNS, "entity d")
def har_daily_features(spark, sf):
    return feats.har_daily(joined(spark, sf))


@query(JOINED + f"""x AS (SELECT entity, d, ln(views) AS v FROM joined), m AS (SELECT *, {_full('avg', 'v', 60)} AS m60, {_full('stddev_samp', 'v', 60)} AS s60 FROM x),
    z AS (SELECT *, (v - m60) / nullif(s60, 0) AS z FROM m), out AS (SELECT entity, d, lag(z) {W} AS views_z_l1 FROM z)""", "views_z_l1", "entity d")  # fmt: skip
def views_zscore_rich(spark, sf):
    w = ts.series(KEYS)
    v = positive_ln(F.col("views"))
    x = joined(spark, sf).withColumns({"m": ts.rolling_mean(v, 60, w), "s": ts.rolling_std(v, 60, w)}).withColumn("z", F.try_divide(v - F.col("m"), F.col("s")))
    return x.select("entity", "d", F.lag("z").over(w).alias("views_z_l1"))


@query(PRICES + "out AS (SELECT entity, d, " + ", ".join(f"CAST(isodow(d) - 1 = {k} AS DOUBLE) AS dow_{k}" for k in (1, 2, 3, 4)) + " FROM prices)", "dow_1 dow_2 dow_3 dow_4", "entity d")
def weekday_dummies(spark, sf):
    return b.prices(spark, sf).select("entity", "d", *(weekday_dummy(F.col("d"), k).alias(f"dow_{k}") for k in (1, 2, 3, 4)))


@query(JOINED + RETURNS + "out AS (SELECT CAST(isodow(d) - 1 AS BIGINT) AS dow, count(*) AS n, avg(views) AS mean_views, avg(abs(r)) AS mean_abs_return FROM returns GROUP BY 1)", "mean_views mean_abs_return", "dow n")
def weekday_seasonality(spark, sf):
    x = joined(spark, sf).withColumn("r", ts.log_return(F.col("close"), ts.series(KEYS)))
    return x.groupBy(F.weekday("d").alias("dow")).agg(F.count("*").alias("n"), F.avg("views").alias("mean_views"), F.avg(F.abs("r")).alias("mean_abs_return"))


@query(SESSION + "out AS (SELECT entity, d, count(*) AS n, min(close) AS low, max(close) AS high FROM session GROUP BY ALL)", "low high", "entity d n")
def session_filter_ny(spark, sf):
    return rv.regular_session(b.bars(spark, sf)).groupBy("entity", "d").agg(F.count("*").alias("n"), F.min("close").alias("low"), F.max("close").alias("high"))


@query(SESSION + _rv(1) + "out AS (SELECT * FROM rv)", "rv", "entity d n")
def daily_rv(spark, sf):
    return rv.daily_rv(rv.regular_session(b.bars(spark, sf)), 1, ("t", "event_id"))


@query(WHOLE_DAYS + _rv(2) + "out AS (SELECT * FROM rv)", "rv", "entity d n")
def daily_rv_subsampled(spark, sf):
    return rv.daily_rv(whole_days(spark, sf), 2, ("t", "event_id"))


#: Sampling steps of the signature curve, fixed values.
STEPS = (1, 2, 3, 6, 12)


@query(WHOLE_DAYS + "".join(_rv(k, f"step_{k}") for k in STEPS) + "all_k AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM step_{k}" for k in STEPS) + "), out AS (SELECT entity, CAST(k AS BIGINT) AS k, count(*) AS days, avg(rv) AS mean_rv FROM all_k GROUP BY ALL)", "mean_rv", "entity k days")
def signature_curve(spark, sf):
    return rv.signature_curve(whole_days(spark, sf), STEPS, order=("t", "event_id"))


@query(PSEUDO + VIEWS + f"""j AS (SELECT rv.*, views FROM rv LEFT JOIN views USING (d) WHERE rv > 0),
    a AS (SELECT *, ln(rv) AS y, {_full('avg', 'rv', 5)} AS m5, {_full('avg', 'rv', 22)} AS m22, ln(views) - lag(ln(views)) {W} AS dv FROM j),
    l AS (SELECT entity, d, y, lag(y) {W} AS rv_d_l1, lag(ln(m5)) {W} AS rv_w_l1, lag(ln(m22)) {W} AS rv_m_l1, lag(dv) {W} AS views_l1, lag(dv, 2) {W} AS views_l2,
        {', '.join(f'CAST(isodow(d) - 1 = {k} AS DOUBLE) AS dow_{k}' for k in (1, 2, 3, 4))} FROM a),
    out AS (SELECT * FROM l WHERE rv_m_l1 IS NOT NULL AND views_l2 IS NOT NULL AND views_l1 IS NOT NULL)""", "y rv_d_l1 rv_w_l1 rv_m_l1 views_l1 views_l2 dow_1 dow_2 dow_3 dow_4", "entity d")  # fmt: skip
def har_rv_features(spark, sf):
    return feats.har_intraday(ts.align(pseudo_rv(spark, sf).select("entity", "d", "rv"), b.views(spark, sf), ["d"]))


@query(PSEUDO + PRICES + f"r AS (SELECT d, ln(close) - lag(ln(close)) {W} AS r FROM prices), j AS (SELECT sqrt(rv) AS v, abs(r) AS a FROM rv JOIN r USING (d) WHERE r IS NOT NULL), out AS (SELECT count(*) AS n, corr(v, a) AS correlation FROM j)", "correlation", "n")
def realized_vs_abs_return_corr(spark, sf):
    r = b.prices(spark, sf).select("d", ts.log_return(F.col("close"), ts.series(KEYS)).alias("r"))
    j = pseudo_rv(spark, sf).select("d", "rv").join(r, "d").na.drop(subset=["r"])
    return j.agg(F.count("*").alias("n"), F.corr(F.sqrt("rv"), F.abs("r")).alias("correlation"))


CHANGES = PANEL_JOINED + f"ch AS (SELECT entity, d, ln(views) - lag(ln(views)) {W} AS dv FROM joined), lags AS (SELECT entity, d, lag(dv) {W} AS views_l1, lag(dv, 2) {W} AS views_l2 FROM ch), ok AS (SELECT * FROM lags WHERE views_l1 IS NOT NULL AND views_l2 IS NOT NULL),"


def panel_attention(spark, sf):
    w = ts.series(KEYS)
    x = panel_joined(spark, sf).withColumn("dv", ts.log_return(F.col("views"), w))
    return x.select("entity", "d", F.lag("dv").over(w).alias("views_l1"), F.lag("dv", 2).over(w).alias("views_l2")).na.drop()


@query(CHANGES + "out AS (SELECT d, count(*) AS n, avg(views_l1) AS mean_l1, avg(views_l2) AS mean_l2 FROM ok GROUP BY d)", "mean_l1 mean_l2", "d n")
def cross_section_mean(spark, sf):
    return panel_attention(spark, sf).groupBy("d").agg(F.count("*").alias("n"), F.avg("views_l1").alias("mean_l1"), F.avg("views_l2").alias("mean_l2"))


@query(CHANGES + "out AS (SELECT entity, d, views_l1 - avg(views_l1) OVER (PARTITION BY d) AS views_l1, views_l2 - avg(views_l2) OVER (PARTITION BY d) AS views_l2 FROM ok)", "views_l1 views_l2", "entity d")
def idiosyncratic_attention(spark, sf):
    return feats.idiosyncratic(panel_attention(spark, sf))


def _calendar(spark, sf):
    return b.panel_prices(spark, sf).select("entity").distinct().crossJoin(ts.business_days(spark, "1995-01-02", "2001-07-31"))  # five entities by a literal calendar


@query(REACTIONS + CALENDAR + "near AS (SELECT r.entity, t.d FROM raw r ASOF JOIN days t ON r.entity = t.entity AND r.d <= t.d), out AS (SELECT DISTINCT entity, d FROM near)", "", "entity d")
def earnings_reaction_days(spark, sf):
    return ts.next_day(b.reaction_dates(b.announcements(spark, sf)), _calendar(spark, sf), KEYS)


@query(REACTIONS + CALENDAR + EARN + "m AS (SELECT t.*, h.d IS NOT NULL AS earn FROM days t LEFT JOIN hits h ON h.entity = t.entity AND h.d = t.d), x AS (SELECT *, bool_or(earn) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS earn3 FROM m), out AS (SELECT entity, d, earn, earn3 FROM x WHERE earn3)", "", "entity d earn earn3")
def event_window_3d(spark, sf):
    m = studies.mark_events(_calendar(spark, sf), b.reaction_dates(b.announcements(spark, sf)))
    return m.where("earn3").select("entity", "d", "earn", "earn3")


@query(PANEL + REACTIONS + "days AS (SELECT entity, d FROM panel)," + EARN + f"q AS (SELECT p.entity, p.d, h.d IS NOT NULL AS earn, ln(abs(ln(close) - lag(ln(close)) OVER (PARTITION BY p.entity ORDER BY p.d)) + 1e-6) AS y FROM panel p LEFT JOIN hits h ON h.entity = p.entity AND h.d = p.d), out AS (SELECT entity, CAST(count_if(earn) AS BIGINT) AS n_earn, exp(avg(CASE WHEN earn THEN y END) - avg(CASE WHEN NOT earn THEN y END)) AS earn_rv_ratio FROM q WHERE y IS NOT NULL GROUP BY entity)", "earn_rv_ratio", "entity n_earn")
def event_rv_ratio(spark, sf):
    p = b.panel_prices(spark, sf)
    y = F.ln(F.abs(ts.log_return(F.col("close"), ts.series(KEYS))) + 1e-6)
    marked = studies.mark_events(p.withColumn("y", y), b.reaction_dates(b.announcements(spark, sf)))
    return studies.rv_ratio(marked.where("y is not null"))


# --- Forecasts and tests ---------------------------------------------------


@query(PRICES + _forecasts("prices") + "out AS (SELECT * FROM fc)", "y yhat_base yhat_alt", "entity d rn block")
def walk_forward_ols_1var(spark, sf):
    return one_lag(b.prices(spark, sf)).select("entity", "d", F.col("rn").cast("long"), F.col("block").cast("long"), "y", "yhat_base", "yhat_alt")


@query(JOINED + HAR + _nested("har", feats.DAILY, feats.ATTENTION) + "out AS (SELECT * FROM fc)", "y yhat_base yhat_alt", "entity d rn block")
def walk_forward_ols_har(spark, sf):
    f = feats.har_daily(joined(spark, sf))
    return wf.walk_forward_ols(f, KEYS, feats.DAILY, [*feats.DAILY, *feats.ATTENTION]).select("entity", "d", "rn", "block", "y", "yhat_base", "yhat_alt")


@query(PRICES + _forecasts("prices") + f"out AS (SELECT entity, count(*) AS n_train, regr_slope(y, x) AS coef_x FROM f WHERE rn <= {wf.MIN_TRAIN} GROUP BY entity)", "coef_x", "entity n_train")
def first_window_coef(spark, sf):
    return wf.first_window_coefficient(levels(b.prices(spark, sf)), KEYS, ["x"], "x")


@query(PRICES + _forecasts("prices") + "out AS (SELECT entity, count(*) AS n_oos, sum(e2_base) / count(*) AS mse_base, sum(e2_alt) / count(*) AS mse_alt, 1 - sum(e2_alt) / sum(e2_base) AS r2_oos_gain FROM losses GROUP BY entity)", "mse_base mse_alt r2_oos_gain", "entity n_oos")
def oos_r2_gain(spark, sf):
    x = inf.with_losses(one_lag(b.prices(spark, sf)))
    return x.groupBy("entity").agg(F.count("*").alias("n_oos"), F.avg("e2_base").alias("mse_base"), F.avg("e2_alt").alias("mse_alt"), (1 - F.sum("e2_alt") / F.sum("e2_base")).alias("r2_oos_gain"))


BENCH = "bench AS (SELECT *, coalesce(avg(y) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y) AS bench FROM losses),"


@query(PRICES + _forecasts("prices") + BENCH + "out AS (SELECT entity, count(*) AS n_oos, 1 - sum(e2_base) / sum((y - bench) ** 2) AS r2_oos_baseline FROM bench GROUP BY entity)", "r2_oos_baseline", "entity n_oos")
def expanding_mean_benchmark_r2(spark, sf):
    return inf.compare(one_lag(b.prices(spark, sf)), KEYS).select("entity", "n_oos", "r2_oos_baseline")


@query(PRICES + _forecasts("prices") + f"out AS (SELECT entity, d, sum(d_loss) {W} AS cumulative FROM losses)", "cumulative", "entity d")
def loss_differential_cumsum(spark, sf):
    x = inf.with_losses(one_lag(b.prices(spark, sf)))
    return x.select("entity", "d", ts.running_sum(F.col("d_loss"), ts.series(KEYS)).alias("cumulative"))


@query(PRICES + _forecasts("prices") + _hac("t", "losses", "d_loss") + "out AS (SELECT * FROM t)", "mean se stat p", "entity n")
def dm_test(spark, sf):
    return inf.hac_mean_test(inf.with_losses(one_lag(b.prices(spark, sf))), "d_loss", KEYS)


@query(PANEL + _forecasts("panel") + _hac("t", "losses", "cw_loss") + "out AS (SELECT * FROM t)", "mean se stat p", "entity n")
def clark_west_test(spark, sf):
    return inf.hac_mean_test(panel_losses(spark, sf), "cw_loss", KEYS)


RESULTS = (
    BENCH + _hac("dm", "losses", "d_loss") + _hac("cw", "losses", "cw_loss")
    + """sums AS (SELECT entity, count(*) AS n_oos, 1 - sum(e2_base) / sum((y - bench) ** 2) AS r2_oos_baseline, 1 - sum(e2_alt) / sum(e2_base) AS r2_oos_gain, avg(e2_base) AS m FROM bench GROUP BY entity),
    results AS (SELECT s.entity, n_oos, r2_oos_baseline, r2_oos_gain, dm.se / m AS r2_gain_se, dm.stat AS dm_stat, dm.p AS p_dm, cw.stat AS cw_stat, cw.p AS p_cw FROM sums s JOIN dm USING (entity) JOIN cw USING (entity)),"""
)
COMPARE = PANEL + _forecasts("panel") + RESULTS
RESULT_COLUMNS = "r2_oos_baseline r2_oos_gain r2_gain_se dm_stat p_dm cw_stat p_cw"


def results(spark, sf):
    return inf.compare(one_lag(b.panel_prices(spark, sf)), KEYS)


@query(COMPARE + "out AS (SELECT * FROM results)", RESULT_COLUMNS, "entity n_oos")
def compare_nested(spark, sf):
    return results(spark, sf)


@query(PANEL + _forecasts("panel") + MARKED + "chosen AS (SELECT * FROM marked WHERE earn)," + _hac("dm", "chosen", "d_loss") + _hac("cw", "chosen", "cw_loss") + """
    s AS (SELECT entity, count(*) AS n_earn, 1 - sum(e2_alt) / sum(e2_base) AS g, avg(e2_base) AS m FROM chosen GROUP BY entity),
    out AS (SELECT entity, n_earn, CASE WHEN n_earn >= 10 THEN g END AS earn_r2_gain, CASE WHEN n_earn >= 10 THEN dm.se / m END AS earn_r2_se, CASE WHEN n_earn >= 10 THEN cw.stat END AS earn_cw_stat,
        CASE WHEN n_earn >= 10 THEN cw.p END AS earn_p_cw FROM s JOIN dm USING (entity) JOIN cw USING (entity))""", "earn_r2_gain earn_r2_se earn_cw_stat earn_p_cw", "entity n_earn")  # fmt: skip
def event_restricted_compare(spark, sf):
    return studies.event_compare(marked_losses(spark, sf).select("entity", "d", "y", "yhat_base", "yhat_alt", "earn"), "earn", "earn")


HOLM = "ranked AS (SELECT *, row_number() OVER (ORDER BY p_cw) AS rk, count(*) OVER () AS m FROM results), out AS (SELECT entity, p_cw, least(1, max((m - rk + 1) * p_cw) OVER (ORDER BY p_cw, rk ROWS UNBOUNDED PRECEDING)) AS p_cw_holm FROM ranked)"


@query(COMPARE + HOLM, "p_cw p_cw_holm", "entity")
def holm_by_family(spark, sf):
    return inf.holm(results(spark, sf), "p_cw").select("entity", "p_cw", "p_cw_holm")


@query(PANEL + _forecasts("panel") + "pool AS (SELECT 'all' AS entity, d, avg(cw_loss) AS v FROM losses GROUP BY d)," + _hac("t", "pool", "v") + "out AS (SELECT * FROM t)", "mean se stat p", "entity n")
def pooled_cw(spark, sf):
    return inf.hac_mean_test(inf.pooled_mean(panel_losses(spark, sf), "cw_loss", ["d"]).withColumn("entity", F.lit("all")), "cw_loss", KEYS)


@query(PANEL + _forecasts("panel") + MARKED + "stack AS (SELECT 'all' AS grp, * FROM marked WHERE earn)," + _hac("t", "stack", "cw_loss", "grp", "entity, d", 0) + "out AS (SELECT * FROM t)", "mean se stat p", "grp n")
def event_stacked_cw(spark, sf):
    return inf.hac_mean_test(marked_losses(spark, sf).where("earn").withColumn("grp", F.lit("all")), "cw_loss", ["grp"], ["entity", "d"], 0)


@query(PANEL + _forecasts("panel") + MARKED + "wk AS (SELECT 'all' AS grp, isoyear(d) AS iy, weekofyear(d) AS iw, avg(cw_loss) AS v FROM marked WHERE earn GROUP BY ALL)," + _hac("t", "wk", "v", "grp", "iy, iw", 0) + "out AS (SELECT * FROM t)", "mean se stat p", "grp n")
def week_clustered_cw(spark, sf):
    weekly = inf.week_clustered(marked_losses(spark, sf).where("earn"), "cw_loss").withColumn("grp", F.lit("all"))
    return inf.hac_mean_test(weekly, "cw_loss", ["grp"], ["iso_year", "iso_week"], 0)


@query(PANEL + _forecasts("panel") + MARKED + "chosen AS (SELECT 'primary' AS grp, * FROM marked WHERE earn AND d >= DATE '1998-01-01'), wk AS (SELECT grp, isoyear(d) AS iy, weekofyear(d) AS iw, avg(cw_loss) AS v, count(*) AS c FROM chosen GROUP BY ALL)," + _hac("t", "wk", "v", "grp", "iy, iw", 0) + "out AS (SELECT (SELECT count(*) FROM chosen) AS n_events, n AS n_weeks, stat, p FROM t)", "stat p", "n_events n_weeks")
def reaction_test_in_range(spark, sf):
    return studies.reaction_test(marked_losses(spark, sf), "1998-01-01")


@query(PRICES + "c AS (SELECT d, ln(close) - avg(ln(close)) OVER () AS e FROM prices), n AS (SELECT d, e, row_number() OVER (ORDER BY d) AS i FROM c), out AS (SELECT 'ALL' AS entity, k AS lag, sum(a.e * b.e) / (SELECT sum(e * e) FROM n) AS acf FROM range(0, 41) r(k), n a JOIN n b ON b.i = a.i - k GROUP BY k)", "acf", "entity lag")
def acf_40(spark, sf):
    return inf.autocorrelation(b.prices(spark, sf).withColumn("y", positive_ln(F.col("close"))), "y", KEYS, 40)


@query(JOINED + RETURNS + f"x AS (SELECT d, row_number() OVER (ORDER BY d) AS i, abs(r) AS a, ln(views) - lag(ln(views)) {W} AS dv FROM returns), out AS (SELECT 'ALL' AS entity, k AS lag, corr(s.dv, t.a) AS ccf FROM range(-5, 11) r(k), x t LEFT JOIN x s ON s.i = t.i - k GROUP BY k)", "ccf", "entity lag")
def ccf_lead_lag(spark, sf):
    w = ts.series(KEYS)
    x = joined(spark, sf).withColumns({"a": F.abs(ts.log_return(F.col("close"), w)), "dv": ts.log_return(F.col("views"), w)})
    return inf.cross_correlation(x, "dv", "a", KEYS)


# --- Literal relations and reports -----------------------------------------


def _values(name: str, rows) -> str:
    def say(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"{name} AS (VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + "),"


@query(_values("pairs(target, page)", universe.DAILY_PAIRS) + "models(model) AS (VALUES ('ols'), ('gbm')), flags(dow) AS (VALUES (true), (false)), out AS (SELECT * FROM pairs, models, flags)", "", "target page model dow")
def spec_grid(spark, sf):
    return studies.spec_grid(spark)


@query(COMPARE + """h AS (SELECT 1 AS sub, * FROM results UNION ALL SELECT 2, entity, n_oos, r2_oos_baseline, r2_oos_gain / 2, r2_gain_se, dm_stat, p_dm, cw_stat, p_cw FROM results),
    out AS (SELECT entity, max(CASE WHEN sub = 1 THEN r2_oos_gain END) AS gain_1, max(CASE WHEN sub = 1 THEN p_cw END) AS p_1, max(CASE WHEN sub = 2 THEN r2_oos_gain END) AS gain_2, max(CASE WHEN sub = 2 THEN p_cw END) AS p_2 FROM h GROUP BY entity)""", "gain_1 p_1 gain_2 p_2", "entity")  # fmt: skip
def pivot_results(spark, sf):
    x = results(spark, sf).withColumn("half", F.array(F.struct(F.lit(1).alias("sub"), F.col("r2_oos_gain").alias("g")), F.struct(F.lit(2).alias("sub"), (F.col("r2_oos_gain") / 2).alias("g"))))
    x = x.select("entity", F.explode("half").alias("h"), "p_cw").select("entity", "h.sub", "h.g", "p_cw")
    wide = x.groupBy("entity").pivot("sub", [1, 2]).agg(F.max("g").alias("gain"), F.max("p_cw").alias("p"))
    return wide.select("entity", F.col("1_gain").alias("gain_1"), F.col("1_p").alias("p_1"), F.col("2_gain").alias("gain_2"), F.col("2_p").alias("p_2"))


@query(COMPARE + "out AS (SELECT CAST(count_if(r2_oos_gain < 0) AS BIGINT) AS n_negative, CAST(count_if(r2_oos_gain > 0) AS BIGINT) AS n_positive, avg(r2_oos_gain) AS mean_gain, min(r2_oos_gain) AS min_gain, max(r2_oos_gain) AS max_gain FROM results)", "mean_gain min_gain max_gain", "n_negative n_positive")
def gain_sign_summary(spark, sf):
    g = F.col("r2_oos_gain")
    return results(spark, sf).agg(F.count_if(g < 0).alias("n_negative"), F.count_if(g > 0).alias("n_positive"), F.avg(g).alias("mean_gain"), F.min(g).alias("min_gain"), F.max(g).alias("max_gain"))


@query(COMPARE + "out AS (SELECT entity, r2_oos_gain, r2_oos_gain - 1.96e0 * r2_gain_se AS ci_low, r2_oos_gain + 1.96e0 * r2_gain_se AS ci_high FROM results)", "r2_oos_gain ci_low ci_high", "entity")
def ci_bounds(spark, sf):
    return confidence_bounds(results(spark, sf), "r2_oos_gain", "r2_gain_se").select("entity", "r2_oos_gain", "ci_low", "ci_high")


@query(_values("c(ord, target, page)", [(i, *r) for i, r in enumerate(universe.CANDIDATES)]) + "out AS (SELECT CAST(ord AS BIGINT) AS ord, target, page FROM c WHERE target NOT IN ('ORCL', 'V') ORDER BY ord LIMIT 20)", "", "ord target page")
def sample_selection(spark, sf):
    return studies.select_sample(studies.pairs_relation(spark, "candidates"), ["ORCL", "V"]).select("ord", "target", "page")


@query(_values("a(target)", [(r[0],) for r in universe.CANDIDATES]) + _values("b(target)", [(r[0],) for r in universe.STOCKS]) + "i AS (SELECT target FROM a INTERSECT SELECT target FROM b), out AS (SELECT count(*) AS shared FROM i)", "", "shared")
def universe_disjoint(spark, sf):
    a, c = (studies.pairs_relation(spark, n).select("target") for n in ("candidates", "stocks"))
    return a.intersect(c).agg(F.count("*").alias("shared"))


@query(PANEL_JOINED + REACTIONS + "days AS (SELECT entity, d FROM panel)," + EARN + f"""q AS (SELECT j.entity, j.d, views, h.d IS NOT NULL AS earn, ln(abs(ln(close) - lag(ln(close)) OVER (PARTITION BY j.entity ORDER BY j.d)) + 1e-6) AS y FROM joined j LEFT JOIN hits h ON h.entity = j.entity AND h.d = j.d),
    s AS (SELECT entity, CAST(count_if(coalesce(views, 0) <= 0) AS BIGINT) AS zero_view_days, CAST(count_if(earn) AS BIGINT) AS n_events, exp(avg(CASE WHEN earn THEN y END) - avg(CASE WHEN NOT earn THEN y END)) AS earn_rv_ratio,
        1 - count(*) / (date_diff('day', min(d), max(d)) + 1)::DOUBLE AS missing_share FROM q GROUP BY entity),
    out AS (SELECT *, CASE WHEN zero_view_days > 0 THEN 'zero_view_days' WHEN n_events < 25 THEN 'few_events' WHEN coalesce(earn_rv_ratio < 1.5e0, true) THEN 'rv_ratio' WHEN missing_share > 0.05e0 THEN 'missing_bars' END AS excluded_by FROM s)""", "earn_rv_ratio missing_share", "entity zero_view_days n_events excluded_by")  # fmt: skip
def exclusion_rules(spark, sf):
    y = F.ln(F.abs(ts.log_return(F.col("close"), ts.series(KEYS))) + 1e-6)
    m = studies.mark_events(panel_joined(spark, sf).withColumn("y", y), b.reaction_dates(b.announcements(spark, sf)))
    s = m.groupBy("entity").agg(
        F.count_if(F.coalesce(F.col("views"), F.lit(0)) <= 0).alias("zero_view_days"), F.count_if("earn").alias("n_events"),
        F.exp(F.avg(F.when(F.col("earn"), F.col("y"))) - F.avg(F.when(~F.col("earn"), F.col("y")))).alias("earn_rv_ratio"),
        (1 - F.count("*") / (F.date_diff(F.max("d"), F.min("d")) + 1)).alias("missing_share"),
    )
    return studies.exclusion_rules(s)


@query(CHANGES + """raw_v AS (SELECT entity, avg(abs(views_l1)) AS raw_size FROM ok GROUP BY entity), dm AS (SELECT entity, views_l1 - avg(views_l1) OVER (PARTITION BY d) AS v FROM ok),
    idio AS (SELECT entity, avg(abs(v)) AS idio_size FROM dm GROUP BY entity), out AS (SELECT entity, raw_size, idio_size, idio_size / raw_size AS ratio FROM raw_v JOIN idio USING (entity))""", "raw_size idio_size ratio", "entity")  # fmt: skip
def raw_vs_idio(spark, sf):
    raw = panel_attention(spark, sf)
    size = lambda df, name: df.groupBy("entity").agg(F.avg(F.abs("views_l1")).alias(name))
    return size(raw, "raw_size").join(size(feats.idiosyncratic(raw), "idio_size"), "entity").withColumn("ratio", F.col("idio_size") / F.col("raw_size"))


@query("x AS (SELECT event_type AS entity, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), out AS (SELECT entity, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM x GROUP BY entity)", "", "entity n total")
def json_items_ingest(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return b.table(spark, sf, "events").groupBy(F.col("event_type").alias("entity")).agg(F.count(k).alias("n"), F.sum(k).alias("total"))


@query("g AS (SELECT (range - 80) / 10e0 AS x FROM range(0, 161)), out AS (SELECT x, 1 - (" + _sf("x") + ") AS phi FROM g)", "x phi", "")
def normal_cdf(spark, sf):
    x = ((F.col("id") - 80) / 10).alias("x")
    return spark.range(161).select(x).withColumn("phi", norm_cdf(F.col("x")))


# --- Rows only: fits, simulation, trees ------------------------------------


@query()
def adf_test(spark, sf):
    return inf.adf_test(feats.har_daily(joined(spark, sf)), "y", KEYS)


@query()
def sim_rejection_rate(spark, sf):
    return simulation.rejection_rates(simulation.null_panel(spark))


@query()
def gbm_walk_forward(spark, sf):
    f = feats.har_daily(joined(spark, sf), rich=True)
    fc = wf.walk_forward_trees(f, KEYS, feats.DAILY, [*feats.DAILY, *feats.ATTENTION, *feats.RICH], refit=wf.REFIT_TREES, rounds=150)
    return inf.compare(fc, KEYS).drop("cw_stat", "p_cw")


@query()
def daily_study(spark, sf):
    return studies.daily_study(joined(spark, sf))


@query()
def intraday_study(spark, sf):
    return studies.intraday_study(ts.align(pseudo_rv(spark, sf).select("entity", "d", "rv"), b.views(spark, sf), ["d"]))


# --- Studies of the panel with events --------------------------------------


def _event(prefix: str, flag: str, least: int = 10) -> str:
    """Relation ``prefix``: the comparison on flagged rows alone, null below ``least`` of them."""
    shown = ", ".join(f"CASE WHEN n >= {least} THEN {x} END AS {prefix}_{c}" for c, x in (("r2_gain", "g"), ("r2_se", "dm_se / m"), ("cw_stat", "cw_stat"), ("p_cw", "cw_p")))
    return f"""
{prefix}_rows AS (SELECT * FROM losses WHERE {flag}),""" + _hac(f"{prefix}_dm", f"{prefix}_rows", "d_loss") + _hac(f"{prefix}_cw", f"{prefix}_rows", "cw_loss") + f"""
{prefix}_sums AS (SELECT entity, count(*) AS n, 1 - sum(e2_alt) / sum(e2_base) AS g, avg(e2_base) AS m FROM {prefix}_rows GROUP BY entity),
{prefix}_all AS (SELECT s.*, x.se AS dm_se, c.stat AS cw_stat, c.p AS cw_p FROM {prefix}_sums s JOIN {prefix}_dm x USING (entity) JOIN {prefix}_cw c USING (entity)),
{prefix} AS (SELECT entity, n AS n_{prefix}, {shown} FROM {prefix}_all),"""  # fmt: skip


def _holm(name: str, source: str, p: str) -> str:
    return f"""
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}) AS _rk, count({p}) OVER () AS _m FROM {source}),
{name} AS (SELECT * EXCLUDE (_rk, _m), CASE WHEN {p} IS NOT NULL THEN least(1, max((_m - _rk + 1) * {p}) OVER (PARTITION BY {p} IS NULL ORDER BY _rk ROWS UNBOUNDED PRECEDING)) END AS {p}_holm FROM {name}_k),"""


def _shown(prefix: str) -> str:
    return " ".join(f"{prefix}_{c}" for c in ("r2_gain", "r2_se", "cw_stat", "p_cw", "p_cw_holm"))


def _pooled(name: str, source: str, lags: int, by: str = "") -> str:
    """Relation ``name``: the mean adjusted loss tested over dates, weeks (``by``) or single rows."""
    rows = f"SELECT '{name}' AS test, {by}, avg(cw_loss) AS v FROM {source} GROUP BY ALL" if by else f"SELECT '{name}' AS test, d, cw_loss AS v FROM {source}"
    return f"{name}_v AS ({rows})," + _hac(name, f"{name}_v", "v", "test", "d" if "isoyear" not in by else "iy, iw", lags)


WEEKS = "isoyear(d) AS iy, weekofyear(d) AS iw"
FLAGGED = (
    PANEL_JOINED + HAR + REACTIONS + "days AS (SELECT entity, d FROM har)," + EARN
    + """hit_rows AS (SELECT r.*, h.d IS NOT NULL AS earn FROM har r LEFT JOIN hits h ON h.entity = r.entity AND h.d = r.d),
    flagged AS (SELECT *, CAST(earn AS DOUBLE) AS event, bool_or(earn) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS earn3 FROM hit_rows),
    idio AS (SELECT * REPLACE (views_l1 - avg(views_l1) OVER (PARTITION BY d) AS views_l1, views_l2 - avg(views_l2) OVER (PARTITION BY d) AS views_l2) FROM flagged),
    ratio AS (SELECT entity, exp(avg(CASE WHEN earn THEN y END) - avg(CASE WHEN NOT earn THEN y END)) AS earn_rv_ratio FROM flagged GROUP BY entity),"""
)
EVENT_CONTROL, KEPT = [*feats.DAILY, "event"], ["earn", "earn3"]
RAW_FORECASTS = FLAGGED + _nested("flagged", EVENT_CONTROL, feats.ATTENTION, KEPT)
IDIO_FORECASTS = FLAGGED + _nested("idio", EVENT_CONTROL, feats.ATTENTION, KEPT)
REPLICATION = IDIO_FORECASTS + RESULTS + _event("earn1", "earn") + "both_rows AS (SELECT * FROM results JOIN ratio USING (entity) LEFT JOIN earn1 USING (entity))," + _holm("stocks", "both_rows", "earn1_p_cw")


def _marked_panel(spark, sf):
    f = feats.har_daily(panel_joined(spark, sf))
    return studies.mark_events(f, b.reaction_dates(b.announcements(spark, sf)))


@query(RAW_FORECASTS + RESULTS + _event("earn", "earn") + "both_rows AS (SELECT * FROM results LEFT JOIN earn USING (entity))," + _holm("h1", "both_rows", "p_cw") + _holm("h2", "h1", "earn_p_cw") + "out AS (SELECT * FROM h2)", f"{RESULT_COLUMNS} p_cw_holm {_shown('earn')}", "entity n_oos n_earn")
def panel_study(spark, sf):
    return studies.panel_study(_marked_panel(spark, sf), KEYS, feats.DAILY)[0]


@query(RAW_FORECASTS + _pooled("pooled_cw", "losses", inf.LAGS, "d") + "out AS (SELECT * FROM pooled_cw)", "stat p", "test n")
def panel_study_pooled(spark, sf):
    return studies.panel_study(_marked_panel(spark, sf), KEYS, feats.DAILY)[1]


@query(IDIO_FORECASTS + RESULTS + _event("earn1", "earn") + _event("earn3", "earn3") + "both_rows AS (SELECT * FROM results JOIN ratio USING (entity) LEFT JOIN earn1 USING (entity) LEFT JOIN earn3 USING (entity))," + _holm("h1", "both_rows", "p_cw") + _holm("h2", "h1", "earn1_p_cw") + _holm("h3", "h2", "earn3_p_cw") + "out AS (SELECT * FROM h3)", f"{RESULT_COLUMNS} p_cw_holm earn_rv_ratio {_shown('earn1')} {_shown('earn3')}", "entity n_oos n_earn1 n_earn3")
def stock_study(spark, sf):
    return studies.stock_study(_marked_panel(spark, sf), feats.DAILY, True)[0]


@query(REPLICATION + "out AS (SELECT * FROM stocks)", f"{RESULT_COLUMNS} earn_rv_ratio {_shown('earn1')}", "entity n_oos n_earn1")
def replication_stocks(spark, sf):
    return studies.replication(_marked_panel(spark, sf), feats.DAILY)[0]


@query(IDIO_FORECASTS + "one AS (SELECT * FROM losses WHERE earn), three AS (SELECT * FROM losses WHERE earn3)," + _pooled("all_days", "losses", inf.LAGS, "d")
    + _pooled("reaction_day_stacked", "one", 0) + _pooled("reaction_day_by_week", "one", 0, WEEKS) + _pooled("three_days_stacked", "three", 0) + _pooled("three_days_by_week", "three", 0, WEEKS)
    + "out AS (" + " UNION ALL ".join(f"SELECT test, n, stat, p FROM {t}" for t in ("all_days", "reaction_day_stacked", "reaction_day_by_week", "three_days_stacked", "three_days_by_week")) + ")", "stat p", "test n")
def stock_study_pooled(spark, sf):
    return studies.stock_study(_marked_panel(spark, sf), feats.DAILY, True)[1]


@query(REPLICATION + "chosen AS (SELECT * FROM losses WHERE earn)," + _pooled("primary_test", "chosen", 0, WEEKS) + f"""
    counts AS (SELECT count(*) AS n_events, count(DISTINCT (isoyear(d), weekofyear(d))) AS weeks FROM chosen),
    gains AS (SELECT avg(earn1_r2_gain) AS mean_stock_r2_gain, CAST(count_if(earn1_r2_gain > 0) AS BIGINT) AS n_stocks_positive, count(earn1_p_cw) AS n_stocks FROM stocks),
    v AS (SELECT n_events, CASE WHEN n_events >= 3 THEN weeks ELSE 0 END AS n_weeks, CASE WHEN n_events >= 3 THEN stat END AS stat, CASE WHEN n_events >= 3 THEN p END AS p, gains.* FROM counts LEFT JOIN primary_test ON true, gains),
    out AS (SELECT *, coalesce(p < {universe.ALPHA} AND mean_stock_r2_gain > 0, false) AS success FROM v)""", "stat p mean_stock_r2_gain", "n_events n_weeks n_stocks_positive n_stocks success")  # fmt: skip
def replication_verdict(spark, sf):
    return studies.replication(_marked_panel(spark, sf), feats.DAILY)[1]
