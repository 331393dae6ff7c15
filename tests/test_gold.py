"""Small cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shardwise.functions.linear import probability
from shardwise.functions.schedules import epochs_in_round, eta0, trees_in_round
from shardwise.operators import aggregate, evaluate
from shardwise.operators.linear import learner, local_fit
from shardwise.operators.sampling import split_quotas
from shardwise.sources.state import PARAMS_SCHEMA

CASES = {
    "M1": ([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 0], (2, 1, 1, 2), (2 / 3, 2 / 3, 2 / 3, 2 / 3, 1 / 3, 1 / 3)),
    "M2": ([0] * 8 + [1] * 2, [0] * 7 + [1, 1, 0], (7, 1, 1, 1), (0.8, 0.8, 0.8, 0.8, 0.125, 0.5)),
    "M3": ([0] * 4, [0] * 4, (4, 0, 0, 0), (1.0, 1.0, 1.0, 1.0, 0.0, 0.0)),
    "M4": ([1, 1, 0], [0, 0, 0], (1, 0, 2, 0), (1 / 3, 0.0, 0.0, 0.0, 0.0, 1.0)),
}


def test_confusion_metrics(spark):
    rows = [(name, y, p, 0.5) for name, (ys, ps, _, _) in CASES.items() for y, p in zip(ys, ps)]
    scored = spark.createDataFrame(rows, "name string, label int, pred int, proba double")
    counts = {r["name"]: tuple(r)[1:] for r in evaluate.confusion(scored, ["name"]).collect()}
    found = {r["name"]: tuple(r)[3:] for r in evaluate.metrics(scored, ["name"]).collect()}
    for name, (_, _, confusion, metrics) in CASES.items():
        assert counts[name] == confusion
        assert found[name] == pytest.approx(metrics, abs=1e-9)


def test_losses(spark):
    df = spark.createDataFrame([(1, 2.0), (0, -3.0), (1, 0.5), (0, -0.5)], "label int, decision double").withColumn("g", F.lit(0))
    assert evaluate.hinge_loss(df, ["g"]).first()["loss"] == pytest.approx(0.625)
    assert evaluate.hinge_loss(df, ["g"], signed=True).first()["loss"] == pytest.approx(0.25)
    for loss, expected in (("log_loss", 0.280917332744), ("modified_huber", 0.143841036226)):
        scored = df.withColumn("proba", probability(F.col("decision"), loss))
        assert evaluate.log_loss(scored, ["g"]).first()["loss"] == pytest.approx(expected, abs=1e-9)


def test_missing_probability_falls_back_to_accuracy(spark):
    df = spark.createDataFrame([(1, 1, None), (0, 1, 0.2)], "label int, pred int, proba double").withColumn("g", F.lit(0))
    assert evaluate.metrics(df, ["g"]).first()["loss"] == pytest.approx(0.5)


def test_split_quotas(spark):
    groups = {0: (8, 2), 1: (7, 4), 2: (5, 5), 3: (6, 3), 4: (2, 1)}
    counts = spark.createDataFrame([(g, k, n) for g, ns in groups.items() for k, n in enumerate(ns)], "g int, label int, n bigint")
    found = {(r["g"], r["label"]): (r["r"], r["feasible"]) for r in split_quotas(counts, ["g"], "label", 0.2).collect()}
    expected = {0: (2, 0), 1: (2, 1), 2: (1, 1), 3: (1, 1)}
    for g, rows in expected.items():
        assert [found[g, k] for k in (0, 1)] == [(rows[0], True), (rows[1], True)]
    assert not found[4, 0][1]


def _params(spark, rows):
    return spark.createDataFrame(rows, PARAMS_SCHEMA)


def test_fedavg(spark):
    params = _params(spark, [(1, 0, 100, "ok", [1.0, -2.0], 0.5), (1, 1, 300, "ok", [5.0, 2.0], -0.5), (1, 2, 50, "failed", [float("nan"), 9.0], 9.0)])
    merged = aggregate.fedavg(params).first()
    assert (merged["coef"], merged["intercept"], merged["n_examples"]) == ([4.0, 1.0], -0.25, 400)
    assert aggregate.fedavg(params, accept_failures=False).count() == 0
    previous = _params(spark, [(0, None, 10, "ok", [7.0, 7.0], 7.0)])
    kept = aggregate.fedavg(params, previous, accept_failures=False).first()
    assert (kept["round"], kept["coef"]) == (1, [7.0, 7.0])


def test_averaging_equal_models_gives_the_model(spark):
    merged = aggregate.fedavg(_params(spark, [(1, c, 10 + c, "ok", [0.3, -0.7], None) for c in range(5)])).first()
    assert merged["coef"] == pytest.approx([0.3, -0.7]) and merged["intercept"] is None


def test_metric_guards(spark):
    rows = spark.createDataFrame([(1, 30, 0.5), (1, 10, None), (2, 0, 0.9)], "round int, n_examples bigint, accuracy double")
    found = {r["round"]: r["accuracy"] for r in aggregate.aggregate_accuracy(rows).collect()}
    assert found == {1: 0.375, 2: 0.0}


def test_logistic_epochs(spark):
    data = spark.createDataFrame([(0, 1, [1.0]), (0, 1, [2.0]), (0, 0, [-1.0]), (0, 0, [-2.0])], "client_id int, label int, x array<double>")
    start = _params(spark, [(0, None, 0, "ok", [0.0], 0.0)])
    made = learner("log_loss", None, 1, tol=None)
    for epochs, weight in ((1, 0.375), (2, 0.637244000424)):
        row = local_fit(data, start, made, epochs, step=0.5).first()
        assert row["coef"][0] == pytest.approx(weight, abs=1e-9) and row["intercept"] == pytest.approx(0.0, abs=1e-12)


def test_schedules():
    assert [trees_in_round(r) for r in range(1, 6)] == [10, 15, 15, 20, 20]
    assert (eta0(1), eta0(10)) == (pytest.approx(0.0090909091), 0.005)
    assert [epochs_in_round(r, 15, "hinge") for r in (5, 6)] == [15, 30]
    assert epochs_in_round(6, 20, "log_loss") == 20
