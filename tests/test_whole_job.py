"""Registered queries do the whole job of their operators."""

import inspect

import numpy as np
import pandas as pd

from tarnvol.operators import walkforward as wf
from tarnvol.plans import catalogue, simulation, studies

DATA = "/root/testdata/sf0.01"


def _arguments(monkeypatch, module, name):
    """The bound arguments of each call of a module's function, which still runs."""
    real, calls = getattr(module, name), []

    def spy(*a, **k):
        bound = inspect.signature(real).bind(*a, **k)
        bound.apply_defaults()
        calls.append(bound.arguments)
        return real(*a, **k)

    monkeypatch.setattr(module, name, spy)
    return calls


def test_tree_query_has_all_refits_and_rounds(spark, monkeypatch):
    calls = _arguments(monkeypatch, wf, "walk_forward_trees")
    catalogue.QUERIES["gbm_walk_forward"](spark, DATA)
    assert [(c["refit"], c["rounds"], c["min_train"]) for c in calls] == [(63, 150, 750)]


def test_trees_dealt_by_block_equal_one_loop(spark):
    rng = np.random.default_rng(5)
    part = pd.DataFrame({"entity": np.repeat(["a", "b", "short"], [140, 121, 50]), "d": np.r_[0:140, 0:121, 0:50], "x": rng.normal(size=311), "z": rng.normal(size=311)})
    part["y"] = part.x + 0.5 * part.z + rng.normal(scale=0.1, size=311)
    fc = wf.walk_forward_trees(spark.createDataFrame(part), ["entity"], ["x"], ["x", "z"], min_train=80, refit=20, rounds=4)
    got = {(r.entity, r.d): (r.rn, r.block, r.y, r.yhat_base, r.yhat_alt) for r in fc.collect()}
    want = {}
    for e, one in part.groupby("entity"):
        for d in range(80, len(one)):
            b = (d - 80) // 20
            until, x, y = 80 + 20 * b, one[["x", "z"]].to_numpy(), one.y.to_numpy()
            fit = lambda c: wf.BoostedTrees(rounds=4).fit(x[:until, :c], y[:until]).predict(x[d : d + 1, :c])[0]  # noqa: E731, B023
            want[e, d] = (d + 1, b, y[d], fit(1), fit(2))
    assert got == want


def test_intraday_query_has_all_cells_of_the_grid(spark):
    rows = catalogue.QUERIES["intraday_study"](spark, DATA).collect()
    assert {(r.entity, r.model, r.dow) for r in rows} == {("ALL", m, w) for m in ("ols", "gbm") for w in (False, True)} and len(rows) == 4
    for r in rows:
        assert r.n_oos > 0 and r.p_dm_holm is not None
        assert {r.cw_stat is None, r.p_cw is None, r.p_cw_holm is None} == {r.model == "gbm"}


def test_intraday_trees_have_all_refits_and_rounds(spark, monkeypatch):
    calls = _arguments(monkeypatch, studies, "walk_forward_trees")
    catalogue.QUERIES["intraday_study"](spark, DATA)
    assert [(c["refit"], c["rounds"], c["min_train"]) for c in calls] == [(63, 150, 750)] * 2


def test_simulation_query_has_all_replications(spark, monkeypatch):
    calls = _arguments(monkeypatch, simulation, "null_panel")
    assert catalogue.QUERIES["sim_rejection_rate"](spark, DATA).first().replications == 150
    assert [c["n"] for c in calls] == [1500]
