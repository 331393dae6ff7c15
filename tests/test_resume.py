"""Runs that are cut off and go on."""

from __future__ import annotations

from dataclasses import replace

import pytest

from shardwise.catalog.inputs import FEATURES, KEY, events
from shardwise.config import ForestConfig, LinearConfig
from shardwise.plans import forest_job, linear_job
from shardwise.sources.rounds import read_round_log

LINEAR = LinearConfig(rounds=4, clients=4, local_epochs=1, fit_fraction=0.75, seed=3)
FOREST = ForestConfig(rounds=3, clients=3, trees=4, seed=3)


def tables(run):
    names = ("params", "client_metrics", "round_metrics", "central_metrics") if hasattr(run, "params") else ("nodes", "client_metrics", "round_metrics")
    return {n: sorted(repr(sorted(r.asDict().items())) for r in getattr(run, n).collect()) for n in names}


class CutOff(Exception):
    pass


@pytest.mark.parametrize("at", ["write_params", "commit_round"])
def test_a_linear_run_goes_on_after_its_last_committed_round(spark, sf_dir, tmp_path, monkeypatch, at):
    df = events(spark, sf_dir)
    whole = tables(linear_job.run_linear(df, FEATURES, LINEAR, KEY))
    real, calls = getattr(linear_job, at), []

    def cut(*args):
        calls.append(at)
        if len(calls) == 3:
            raise CutOff
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(linear_job, at, cut)
        with pytest.raises(CutOff):
            linear_job.run_linear(df, FEATURES, LINEAR, KEY, out_dir=str(tmp_path))
    log = read_round_log(spark, f"{tmp_path}/log/csv")
    assert log.count() >= 2
    fitted = []
    real_fit = linear_job.local_fit
    monkeypatch.setattr(linear_job, "local_fit", lambda *a, **k: (fitted.append(k["round_no"]), real_fit(*a, **k))[1])
    run = linear_job.run_linear(df, FEATURES, LINEAR, KEY, out_dir=str(tmp_path), resume=True)
    assert fitted == [3, 4] and tables(run) == whole
    assert [r["round"] for r in read_round_log(spark, f"{tmp_path}/log/json", "json").collect()] == [1, 2, 3, 4]
    if at == "commit_round":
        return
    fitted.clear()
    assert tables(linear_job.run_linear(df, FEATURES, LINEAR, KEY, out_dir=str(tmp_path), resume=True)) == whole and not fitted
    longer = linear_job.run_linear(df, FEATURES, replace(LINEAR, rounds=5), KEY, out_dir=str(tmp_path), resume=True)
    assert fitted == [5] and longer.params.count() == 5
    with pytest.raises(ValueError, match="other settings"):
        linear_job.run_linear(df, FEATURES, replace(LINEAR, seed=4), KEY, out_dir=str(tmp_path), resume=True)


def test_a_forest_run_goes_on_and_keeps_a_log(spark, sf_dir, tmp_path, monkeypatch):
    df = events(spark, sf_dir)
    whole = tables(forest_job.run_forest(df, FEATURES, FOREST, KEY))
    real = forest_job.commit_round

    def cut(spark_, path, key, round_no):
        if round_no == 2:
            raise CutOff
        return real(spark_, path, key, round_no)

    with monkeypatch.context() as m:
        m.setattr(forest_job, "commit_round", cut)
        with pytest.raises(CutOff):
            forest_job.run_forest(df, FEATURES, FOREST, KEY, out_dir=str(tmp_path))
    run = forest_job.run_forest(df, FEATURES, FOREST, KEY, out_dir=str(tmp_path), resume=True)
    assert tables(run) == whole
    log = read_round_log(spark, f"{tmp_path}/log/csv").collect()
    assert [r["round"] for r in log] == [1, 2, 3] and all(r["accuracy"] > 0.5 and r["precision"] is None for r in log)


def test_hooks_take_the_place_of_both_evaluations(spark, sf_dir):
    df, seen = events(spark, sf_dir), {}
    plain = linear_job.run_linear(df, FEATURES, LINEAR, KEY)
    assert [r["round"] for r in plain.central_metrics.orderBy("round").collect()] == [0, 1, 2, 3, 4]

    def central(test, models):
        seen["clients"] = {r["client_id"] for r in test.select("client_id").distinct().collect()}
        return models.selectExpr("round", "coef[0] AS first_weight")

    def worst(clients):
        return clients.groupBy("round").agg({"loss": "max"}).withColumnRenamed("max(loss)", "loss")

    run = linear_job.run_linear(df, FEATURES, replace(LINEAR, central_fn=central, aggregate_fn=worst), KEY)
    weights = {r["round"]: r["coef"][0] for r in run.params.collect()}
    found = {r["round"]: r["first_weight"] for r in run.central_metrics.collect()}
    assert seen["clients"] == {0, 1, 2} and {r: found[r] for r in weights} == weights and set(found) == {0, 1, 2, 3, 4}
    losses = {}
    for r in plain.client_metrics.collect():
        losses[r["round"]] = max(losses.get(r["round"], 0.0), r["loss"])
    assert {r["round"]: r["loss"] for r in run.round_metrics.collect()} == losses
