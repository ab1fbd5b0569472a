"""Known answers, no look-ahead, edge cases and numpy references of the forecasting engine."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnvol.functions.scalars import announced, norm_sf, reaction_day
from tarnvol.operators import features, inference, realized, timeseries, walkforward
from tarnvol.plans import simulation, studies, universe
from tarnvol.sources import readers, sinks

BASE = list(features.INTRADAY)


def test_constant_step_day(spark):
    t0 = dt.datetime(2024, 3, 4, 14, 30)
    bars = spark.createDataFrame([("A", t0 + dt.timedelta(minutes=15 * i), 100 * math.exp(0.001 * i)) for i in range(26)], "entity string, t timestamp_ntz, close double")
    rows = realized.daily_rv(realized.regular_session(bars)).collect()
    assert len(rows) == 1 and rows[0]["n"] == 25 and rows[0]["rv"] == pytest.approx(25e-6, abs=1e-12)


def test_session_follows_daylight_saving_and_excludes_late_seconds(spark):
    at = ["2024-03-08 14:30:00", "2024-03-11 13:30:00", "2024-03-11 19:59:00", "2024-03-11 19:59:01", "2024-03-08 13:30:00"]
    bars = spark.createDataFrame([("A", dt.datetime.fromisoformat(a), 1.0) for a in at], "entity string, t timestamp_ntz, close double")
    assert realized.regular_session(bars).count() == 3


@pytest.mark.parametrize("bars,kept", [(10, 0), (11, 1)])
def test_least_returns(spark, bars, kept):
    d = dt.date(2024, 1, 2)
    df = spark.createDataFrame([("A", d, i, 1.0 + i) for i in range(bars)], "entity string, d date, i int, close double")
    assert realized.daily_rv(df, 1, ("i",)).count() == kept


def test_zero_tick_gives_null_returns_not_infinities(spark):
    d = dt.date(2024, 1, 2)
    df = spark.createDataFrame([("A", d, i, 0.0 if i == 5 else 2.0) for i in range(20)], "entity string, d date, i int, close double")
    row = realized.daily_rv(df, 1, ("i",)).first()
    assert row["rv"] == 0.0 and row["n"] == 17


def test_reaction_days(spark):
    raw = [("A", "2024-03-07 16:00:00-05:00"), ("A", "2024-03-12 07:00:00-04:00"), ("A", "2024-03-15 16:00:00-04:00"), ("A", "2024-03-30 07:00:00-04:00")]
    events = spark.createDataFrame(raw, "entity string, raw string").select("entity", reaction_day(announced(F.col("raw"))).alias("d"))
    days = timeseries.business_days(spark, "2024-03-04", "2024-03-22").withColumn("entity", F.lit("A"))
    got = {r["d"].isoformat() for r in timeseries.next_day(events, days, ["entity"]).collect()}
    assert got == {"2024-03-08", "2024-03-12", "2024-03-18"}
    early = spark.createDataFrame([("A", dt.date(2020, 1, 1))], "entity string, d date")
    assert timeseries.next_day(early, days, ["entity"]).first()["d"] == dt.date(2024, 3, 4)
    assert timeseries.next_day(early, days, ["entity"], drop_before_start=True).count() == 0


def _daily(n=300, bump=False, zero=False):
    rng = np.random.default_rng(3)
    d = pd.bdate_range("2020-01-01", periods=n)
    px, v = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), rng.integers(1000, 2000, n).astype(float)
    if bump:
        px[-1] *= math.exp(0.5)
        v[-1] *= 6
    if zero:
        v[100] = 0
    return pd.DataFrame({"entity": "A", "d": d.date, "close": px, "views": v})


@pytest.mark.parametrize("rich", [False, True])
def test_no_look_ahead(spark, rich):
    a, b = (features.har_daily(spark.createDataFrame(_daily(bump=x).sample(frac=1, random_state=1)), rich=rich).orderBy("d").toPandas() for x in (False, True))
    xs = [c for c in a.columns if c != "y"]
    pd.testing.assert_frame_equal(a[xs], b[xs])
    pd.testing.assert_frame_equal(a[:-1], b[:-1])


def test_zero_views_drop_rows_only(spark):
    a, b = (features.har_daily(spark.createDataFrame(_daily(zero=z))) for z in (False, True))
    assert 0 < a.count() - b.count() <= 3
    assert b.where(F.col("views_l1").isin(float("inf"), float("-inf"))).count() == 0


def test_forecasts_match_refitting_from_scratch(spark):
    rng = np.random.default_rng(0)
    n = 140
    pdf = pd.DataFrame({"entity": "A", "d": range(n), "x1": rng.normal(size=n), "x2": rng.normal(size=n), "none": 0.0})
    pdf["twice"], pdf["y"] = pdf.x1, 1 + pdf.x1 - pdf.x2 + rng.normal(size=n)
    xs = ["x1", "x2", "none", "twice"]
    got = walkforward.walk_forward_ols(spark.createDataFrame(pdf), ["entity"], ["x1"], xs, min_train=100, refit=21).toPandas().set_index("d")
    assert sorted(got.index) == list(range(100, n)) and got.block.max() == 1
    for names, col in ((["x1"], "yhat_base"), (xs, "yhat_alt")):
        x = np.column_stack([np.ones(n), pdf[names]])
        for t0 in range(100, n, 21):
            beta = np.linalg.lstsq(x[:t0], pdf.y[:t0], rcond=None)[0]
            t = np.arange(t0, min(n, t0 + 21))
            np.testing.assert_allclose(got.loc[t, col], x[t] @ beta, atol=1e-9)


def test_short_series_has_no_forecast(spark):
    df = spark.createDataFrame([("A", i, float(i), 1.0) for i in range(5)], "entity string, d int, y double, x double")
    assert walkforward.walk_forward_ols(df, ["entity"], [], ["x"], min_train=10).count() == 0


def _hac(f, lags):
    e = f - f.mean()
    s = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return f.mean() / (math.sqrt(s) / len(f))


@pytest.mark.parametrize("lags", [0, 5])
@pytest.mark.parametrize("partitions", [1, 7])
def test_hac(spark, lags, partitions):
    f = np.random.default_rng(1).normal(0.1, 1, 200)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(f)] + [("A", 999, None), ("B", 0, 1.0), ("B", 1, 1.0)], "entity string, d int, v double").repartition(partitions)
    got = {r["entity"]: r for r in inference.hac_mean_test(df, "v", ["entity"], lags=lags).collect()}
    assert got["A"]["n"] == 200 and got["A"]["stat"] == pytest.approx(_hac(f, lags), rel=1e-9)
    assert got["A"]["p"] == pytest.approx(0.5 * math.erfc(got["A"]["stat"] / math.sqrt(2)), abs=1e-14)
    assert got["B"]["stat"] is None


def test_published_pairs_of_statistic_and_p(spark):
    # Published statistics and one-sided p.
    pairs = [(1.96373, 0.02478), (1.5201, 0.06424), (1.22814, 0.1097)]
    for stat, p in pairs:
        assert spark.range(1).select(norm_sf(F.lit(stat))).first()[0] == pytest.approx(p, abs=2e-5)


def test_holm(spark):
    # Published raw and adjusted p.
    raw, adjusted = [0.84305, 0.09864, 0.92113, 0.42995, 0.01874, 0.83546], [1, 0.4932, 1, 1, 0.11243, 1]
    rows = [("f", i, p) for i, p in enumerate(raw)] + [("f", 9, None), ("g", 10, 0.03), ("g", 11, 0.03)]
    got = {r["i"]: r["p_holm"] for r in inference.holm(spark.createDataFrame(rows, "fam string, i int, p double"), "p", ["fam"]).collect()}
    assert [got[i] for i in range(6)] == pytest.approx(adjusted, abs=1e-4)
    assert got[9] is None and got[10] == got[11] == pytest.approx(0.06)


def test_iso_week_boundary(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3), 1.0), (dt.date(2020, 12, 28), 3.0), (dt.date(2021, 1, 4), 5.0)], "d date, v double")
    got = {(r["iso_year"], r["iso_week"]): r["v"] for r in inference.week_clustered(df, "v").collect()}
    assert got == {(2020, 53): 2.0, (2021, 1): 5.0}


@pytest.mark.parametrize("effect", [1.0, 0.0])
def test_planted_and_absent_effect(spark, effect):
    panel = simulation.planted_panel(spark, effect=effect).cache()
    rows, verdict = studies.replication(panel, BASE)
    v = verdict.first()
    assert v["n_events"] > 60 and v["n_weeks"] <= v["n_events"]
    if effect:
        assert v["success"] and v["p"] < 0.01 and v["n_stocks_positive"] >= 4 and rows.count() == 6
    else:
        assert not v["success"] and v["p"] > 0.01
        late = studies.replication(panel, BASE, "2020-01-01")[1].first()
        assert 0 < late["n_events"] < v["n_events"]


def test_selection_and_lock(spark):
    got = studies.select_sample(studies.pairs_relation(spark, "candidates"), ["ORCL", "V"]).collect()
    assert len(got) == 20 and got[0]["target"] == "LLY"
    assert not {c[0] for c in universe.CANDIDATES} & {c[0] for c in universe.STOCKS}
    with pytest.raises(SystemExit):
        studies.refuse_before("new", today=dt.date(2026, 11, 30))
    studies.refuse_before("new", today=dt.date(2026, 12, 1))


def test_size_of_tests(spark):
    r = simulation.rejection_rates(simulation.null_panel(spark, 30, 800)).first()
    assert r["replications"] == 30 and r["dm_rejection"] <= 0.1 and r["cw_rejection"] <= 0.2


def test_unit_root():
    rng = np.random.default_rng(5)
    walk, noise = np.cumsum(rng.normal(size=800)), rng.normal(size=800)
    assert inference.adf_statistic(walk)[1] > 0.05 and inference.adf_statistic(noise)[1] < 1e-6


def test_trees_learn_a_step_and_repeat():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    a, b = (walkforward.BoostedTrees(rounds=100).fit(x, y).predict(x) for _ in range(2))
    assert np.mean((a - y) ** 2) < 0.05 and np.array_equal(a, b)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"items": [{"article": "P", "timestamp": "2024010200", "views": 7}]}')
    row = readers.read_views_json(spark, str(tmp_path / "v.json")).first()
    assert (row["page"], row["d"], row["views"]) == ("P", dt.date(2024, 1, 2), 7)
    (tmp_path / "b.json").write_text('{"symbol": "A", "bars": [{"t": "2024-01-02T14:30:00Z", "c": 1.5}], "next_page_token": null}')
    assert readers.read_bars_json(spark, str(tmp_path / "b.json")).first()["close"] == 1.5
    made = []
    for _ in range(2):
        readers.landed(spark, str(tmp_path / "landed"), lambda: made.append(1) or spark.range(3))
    assert len(made) == 1
    sinks.write_results(spark.createDataFrame([(1, 0.1234567)], "a int, b double"), str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out"), "a int, b double").first()["b"] == 0.12346


def test_retry_pages_and_credentials(monkeypatch):
    answers, waits = [(429, b""), (429, b""), (200, b"ok")], []
    assert readers.with_retry(lambda: answers.pop(0), sleep=waits.append) == b"ok" and waits == [0, 5, 15]
    with pytest.raises(RuntimeError):
        readers.with_retry(lambda: (500, b""), sleep=lambda _: None)
    book = {None: {"bars": [1, 2], "next_page_token": "x"}, "x": {"bars": None, "next_page_token": "y"}, "y": {"bars": [3]}}
    assert list(readers.pages(book.__getitem__, "bars")) == [1, 2, 3]
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(RuntimeError):
        readers.credentials("NO_SUCH_KEY")


def test_streaming_daily_rv(spark, tmp_path):
    from tarnvol.streaming.daily_rv import streaming_rv

    t0 = dt.datetime(2024, 1, 2, 10)
    bars = spark.createDataFrame([("A", t0 + dt.timedelta(minutes=i), math.exp(0.01 * i)) for i in range(5)] + [("A", t0 + dt.timedelta(days=5), 1.0)], "entity string, t timestamp, close double")
    bars.write.parquet(str(tmp_path / "in"))
    stream = streaming_rv(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rv_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from rv_stream").collect()
    assert len(rows) == 1 and rows[0]["n"] == 4 and rows[0]["rv"] == pytest.approx(4e-4)
