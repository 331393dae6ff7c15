"""Parameters as blocks, all rounds as one product, moments of wide vectors: each against the plain form."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwise.operators import evaluate, linear, scaling
from shardwise.operators.linear import initial_params, learner, local_fit
from shardwise.sources.scratch import settle
from shardwise.sources.state import PARAMS_SCHEMA


def _rows(spark, clients=4, width=7, n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x @ np.linspace(1, -1, width) + rng.normal(size=n) > 0.3).astype(int)
    rows = [(0 if k % 3 == 0 else 1 + k % (clients - 1), int(y[k]), x[k].tolist()) for k in range(n)]
    rows += [(9, 0, x[0].tolist()), (9, 0, x[1].tolist())]  # one class only
    return spark.createDataFrame(rows, "client_id int, label int, x array<double>").repartition(5).persist()


def _fitted(df):
    return {r["client_id"]: (r["n_examples"], r["status"], *np.round(r["coef"], 10), round(r["intercept"] or 0.0, 10)) for r in df.collect()}


@pytest.mark.parametrize(("loss", "changes"), [("log_loss", {"tol": 0.08}), ("hinge", {"penalty": "elasticnet"}), ("modified_huber", {"fit_intercept": False, "tol": None})])
def test_blocks_give_the_usual_weights(spark, monkeypatch, loss, changes):
    rows = _rows(spark)
    made = learner(loss, changes.pop("penalty", "l2"), 1, **changes)
    start = settle(initial_params(spark, 7, 3, made.fit_intercept))
    usual = _fitted(local_fit(rows, start, made, 6, form="whole", round_no=1))
    monkeypatch.setattr(linear, "BLOCK_WEIGHTS", 3)
    monkeypatch.setattr(linear, "TASK_VALUES", 100)  # the large client in several parts
    monkeypatch.setattr(linear, "DRIVER_WEIGHTS", 10)  # what makes "auto" take blocks
    assert _fitted(local_fit(rows, start, made, 6, round_no=1)) == usual
    assert usual[9][1] == "failed" and usual[0][1] == "ok"


def test_blocks_start_from_a_clients_own_parameters(spark):
    rows = _rows(spark)
    made = learner("log_loss", "l2", 1, tol=None)
    once = settle(local_fit(rows, settle(initial_params(spark, 7, 3)), made, 2, form="whole", round_no=1))
    assert _fitted(local_fit(rows, once, made, 2, form="blocks")) == _fitted(local_fit(rows, once, made, 2, form="whole"))


@pytest.mark.parametrize("loss", ["log_loss", "hinge", "modified_huber"])
def test_all_rounds_as_one_product(spark, monkeypatch, loss):
    rows, rng = _rows(spark, width=40), np.random.default_rng(2)
    models = [(r, None, 1, "ok", rng.normal(size=40).tolist(), None if r == 2 else float(r)) for r in (1, 2, 3)]
    params = spark.createDataFrame(models, PARAMS_SCHEMA)
    joined = rows.join(F.broadcast(params.select("round", "coef", "intercept")), F.lit(True))
    plain = {(r["round"], r["client_id"]): r for r in evaluate.tally(evaluate.score(joined, loss), ["round", "client_id"], loss).collect()}

    def check(found):
        assert {(r["round"], r["client_id"]) for r in found} == set(plain)
        for r in found:
            p = plain[r["round"], r["client_id"]]
            assert [r[c] for c in ("tn", "fp", "fn", "tp", "loss_rows")] == [p[c] for c in ("tn", "fp", "fn", "tp", "loss_rows")]
            assert r["loss_sum"] == pytest.approx(p["loss_sum"])

    check(evaluate.client_tallies(rows, params, loss).collect())
    monkeypatch.setattr(evaluate, "MODEL_BYTES", 1)  # a pass for each round
    monkeypatch.setattr(evaluate, "GROUPS", 1)
    monkeypatch.setattr(evaluate, "MODEL_ROWS", 1)
    check(evaluate.client_tallies(rows, params, loss).collect())


def test_moments_of_wide_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 40)) * np.linspace(0, 5, 40) + 1e6
    rows = [(0, [None if (k + i) % 50 == 0 else float(v) for i, v in enumerate(r)]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "client_id int, x array<double>").repartition(6)
    names = [f"f{i}" for i in range(40)]
    known = np.array([[(k + i) % 50 != 0 for i in range(40)] for k in range(500)])
    for found in (scaling.fit_scaler(df, names, x="x"), scaling.fit_scaler(df.coalesce(1), names, x="x")):
        for r in found.collect():
            i = int(r["feature"][1:])
            own = x[known[:, i], i]
            assert r["n"] == len(own) and r["mean"] == pytest.approx(own.mean()) and r["scale"] == pytest.approx(own.std() or 1.0, rel=1e-9)
    assert "Generate" not in scaling.fit_scaler(df, names, x="x")._jdf.queryExecution().executedPlan().toString()
    twice = scaling.fit_scaler(df, names, x="x")
    with pytest.raises(ValueError, match="several rows"):
        scaling.apply_scaler(df, twice.unionByName(twice), names, "x")
