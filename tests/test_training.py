"""Local training and the linear job."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwise.config import LinearConfig
from shardwise.functions.hashing import hash_order, normal
from shardwise.operators import aggregate, linear, sgd
from shardwise.operators.linear import gradient_sums, initial_params, learner, local_fit, starting_state
from shardwise.plans import linear_job
from shardwise.plans.linear_job import run_linear
from shardwise.sources.scratch import settle

WIDTH = 4


@pytest.fixture(scope="module")
def data(spark):
    """Three clients, one with most rows; labels follow a known plane."""
    x = [normal(hash_order(11, f"x{i}", "key")) for i in range(WIDTH)]
    margin = 2.0 * F.col("x")[0] - 1.0 * F.col("x")[1] + 0.5
    rows = spark.range(600).select(F.col("id").alias("key"), F.when(F.col("id") % 3 > 0, 0).otherwise(1 + F.col("id") % 2).cast("int").alias("client_id"))
    return rows.withColumn("x", F.array(*x)).withColumn("label", (margin > 0).cast("int")).persist()


def _weights(params):
    return {r["client_id"]: [*r["coef"], r["intercept"] or 0.0] for r in params.collect()}


def _close(a, b, digits=9):
    assert a.keys() == b.keys()
    for client in a:
        assert a[client] == pytest.approx(b[client], abs=10**-digits)


@pytest.mark.parametrize("loss,penalty", [("log_loss", "l2"), ("log_loss", "l1"), ("hinge", "elasticnet"), ("modified_huber", "l2")])
def test_whole_and_by_epoch_agree(spark, data, loss, penalty):
    start, made = initial_params(spark, WIDTH, 1), learner(loss, penalty, 3, tol=None)
    whole = local_fit(data, start, made, 4, form="whole")
    _close(_weights(whole), _weights(local_fit(data, start, made, 4, form="epochs")))


def test_gradient_forms_agree(spark, data):
    made = learner("modified_huber", "l2", 1)
    begin = starting_state(settle(linear.client_stats(data, made)), settle(initial_params(spark, WIDTH, 1)))
    native = gradient_sums(data, begin, made.loss, WIDTH)
    forms = [native, linear._arrow_sums(data, begin, made.loss), linear._exploded_sums(data, begin, made.loss)]
    found = [{r["client_id"]: [*r["g"], r["gb"]] for r in f.collect()} for f in forms]
    _close(found[0], found[1])
    _close(found[0], found[2])


def test_a_restart_continues(spark, data):
    start, made = initial_params(spark, WIDTH, 1), learner("log_loss", "l2", 1, tol=None)
    half = settle(local_fit(data, start, made, 2)).df
    _close(_weights(local_fit(data, half, made, 3)), _weights(local_fit(data, start, made, 5)))


def test_tolerance_stops_both_forms(spark, data):
    start, loose = initial_params(spark, WIDTH, 1), learner("log_loss", "l2", 1, tol=0.5)
    whole, by_epoch = (_weights(local_fit(data, start, loose, 40, form=f)) for f in ("whole", "epochs"))
    _close(whole, by_epoch)
    full = _weights(local_fit(data, start, learner("log_loss", "l2", 1, tol=None), 40))
    assert whole[0] != pytest.approx(full[0], abs=1e-6)


def test_one_class_is_a_failure_not_an_error(spark, data):
    spoiled = data.withColumn("label", F.when(F.col("client_id") == 1, 0).otherwise(F.col("label")))
    for form in ("whole", "epochs"):
        status = {r["client_id"]: r["status"] for r in local_fit(spoiled, initial_params(spark, WIDTH, 1), learner("log_loss", "l2", 1), 2, form=form).collect()}
        assert status == {0: "ok", 1: "failed", 2: "ok"}


def test_divergence_is_a_failure(spark, data):
    huge = local_fit(data, initial_params(spark, WIDTH, 1), learner("modified_huber", None, 1, tol=None), 2, step=float("inf"))
    assert {r["status"] for r in huge.collect()} == {"failed"}


def test_no_intercept(spark, data):
    made = learner("log_loss", "l2", 1, fit_intercept=False)
    for form in ("whole", "epochs"):
        rows = local_fit(data, initial_params(spark, WIDTH, 1, fit_intercept=False), made, 3, form=form).collect()
        assert all(r["intercept"] is None for r in rows)


def test_converges_to_the_optimum(spark, data):
    """The gradient of the penalised objective vanishes."""
    one = data.where("client_id = 1")
    made = learner("log_loss", "l2", 1, tol=None)
    row = local_fit(one, initial_params(spark, WIDTH, 1), made, 4000, form="whole").first()
    pdf = one.toPandas()
    x, y, w = np.array(pdf["x"].tolist()), pdf["label"].to_numpy(), np.array(row["coef"])
    slope = 1 / (1 + np.exp(-(x @ w + row["intercept"]))) - y
    assert np.abs(slope @ x + w).max() < 1e-3 and abs(slope.sum()) < 1e-3


def _plain_sgd(x, y, alpha, l1, l2, epochs, w, b):
    """Row by row with the decaying step, written out."""
    shift = 1.0 / (math.sqrt(1.0 / math.sqrt(alpha)) * alpha)
    t, owed, paid = 1, 0.0, [0.0] * len(w)
    for _ in range(epochs):
        for row, label in zip(x, y):
            eta = 1.0 / (alpha * (shift + t - 1))
            sign = 1 if label else -1
            score = sum(a * c for a, c in zip(w, row)) + b
            w = [c * max(0.0, 1.0 - l2 * eta * alpha) for c in w]
            if sign * score <= 1:
                w = [c + eta * sign * a for c, a in zip(w, row)]
                b += eta * sign
            if l1:
                owed += l1 * eta * alpha
                for i, c in enumerate(w):
                    new = max(0.0, c - owed - paid[i]) if c > 0 else min(0.0, c + owed - paid[i]) if c < 0 else c
                    paid[i] += new - c
                    w[i] = new
            t += 1
    return [*w, b]


@pytest.mark.parametrize("penalty,l1,l2", [("l2", 0.0, 1.0), ("l1", 1.0, 0.0), ("elasticnet", 0.15, 0.85)])
def test_sequential_descent_equals_a_plain_loop(spark, data, penalty, l1, l2):
    fifty = data.where("client_id = 1").orderBy("key").limit(50)
    start, made = settle(initial_params(spark, WIDTH, 1)), learner("hinge", penalty, 1, tol=None)
    ours = _weights(sgd.local_sgd(fifty, start, made, ["key"], 5, epochs=3))[1]
    ordered = fifty.orderBy(hash_order(5, sgd.ORDER, "key")).collect()
    first = start.records()[0]
    plain = _plain_sgd([r["x"] for r in ordered], [r["label"] for r in ordered], 0.001, l1, l2, 3, list(first["coef"]), first["intercept"])
    assert ours == pytest.approx(plain, abs=1e-9)


@pytest.mark.parametrize("loss,penalty", [("hinge", "l1"), ("modified_huber", "l2")])
def test_relayed_chunks_equal_one_task(spark, data, loss, penalty):
    start, made = initial_params(spark, WIDTH, 1), learner(loss, penalty, 1, tol=1e-4)
    whole = sgd.local_sgd(data, start, made, ["key"], 5, epochs=2)
    chunked = sgd.local_sgd(data, start, made, ["key"], 5, epochs=2, chunk_values=150 * (WIDTH + 1))
    _close(_weights(whole), _weights(chunked))


@pytest.mark.parametrize("chunk_values", [sgd.CHUNK_VALUES, 150 * (WIDTH + 1)])
def test_more_clients_than_the_driver_holds(spark, data, monkeypatch, chunk_values):
    start, made = initial_params(spark, WIDTH, 1), learner("hinge", "l2", 1, tol=1e-4)
    held = sgd.local_sgd(data, start, made, ["key"], 5, epochs=2, chunk_values=chunk_values)
    monkeypatch.setattr(sgd, "CLIENT_ROWS", 1)
    _close(_weights(held), _weights(sgd.local_sgd(data, start, made, ["key"], 5, epochs=2, chunk_values=chunk_values)))


def _observations(data):
    return data.select("key", "label", *[F.col("x")[i].alias(f"f{i}") for i in range(WIDTH)])


def test_the_sequential_job_with_more_clients_than_the_driver_holds(data, monkeypatch):
    cfg = LinearConfig(clients=4, rounds=2, loss="hinge", learner="sequential", balance="none", scaler_scope="all", local_epochs=1)
    features = [f"f{i}" for i in range(WIDTH)]
    held = run_linear(_observations(data), features, cfg, "key").params.orderBy("round").collect()
    monkeypatch.setattr(sgd, "CLIENT_ROWS", 1)
    monkeypatch.setattr(linear_job, "CLIENT_ROWS", 1)
    monkeypatch.setattr(linear_job, "settle", lambda df, limit=200_000: settle(df, 1 if "purpose" in df.columns else limit))
    many = run_linear(_observations(data), features, cfg, "key").params.orderBy("round").collect()
    assert len(many) == 2
    for a, b in zip(held, many, strict=True):
        assert a["coef"] == pytest.approx(b["coef"], abs=1e-9)


@pytest.mark.parametrize("learning", ["batch", "sequential"])
def test_the_job_learns(spark, data, tmp_path, learning):
    loss = "log_loss" if learning == "batch" else "hinge"
    cfg = LinearConfig(clients=4, rounds=4, loss=loss, learner=learning, balance="none", scaler_scope="all", local_epochs=10)
    run = run_linear(_observations(data), [f"f{i}" for i in range(WIDTH)], cfg, "key", out_dir=str(tmp_path))
    log = [r.asDict() for r in run.round_metrics.orderBy("round").collect()]
    assert log[-1]["accuracy"] > 0.95 and log[-1]["loss"] <= log[0]["loss"]
    from shardwise.sources.rounds import read_round_log
    from shardwise.sources.state import latest_params

    assert read_round_log(spark, f"{tmp_path}/log/csv").count() == 4
    assert latest_params(spark, f"{tmp_path}/params").first()["coef"] == run.params.where("round = 4").first()["coef"]
    assert run.central_metrics.where("central_accuracy > 0.9").count() >= 1


def test_one_client_is_plain_training(spark, data):
    features = [f"f{i}" for i in range(WIDTH)]
    cfg = LinearConfig(clients=1, rounds=1, balance="none", fit_fraction=1.0, min_clients=1, min_available=1, scaler_scope="all", tol=None, central_clients=(0,))
    start = settle(initial_params(spark, WIDTH, 42)).df
    from shardwise.plans.linear_job import prepare_clients

    run = run_linear(_observations(data), features, cfg, "key", start=start)
    train = prepare_clients(_observations(data), features, cfg, "key").where("split = 'train'")
    plain = local_fit(train, start, learner("log_loss", "l2", 20, tol=None)).first()
    assert run.params.first()["coef"] == pytest.approx(plain["coef"], abs=1e-9)


def test_too_few_clients_keep_the_model(spark, data):
    cfg = LinearConfig(clients=2, rounds=1, balance="none", min_available=3, evaluate_fraction=1.0)
    run = run_linear(_observations(data), [f"f{i}" for i in range(WIDTH)], cfg, "key", start=settle(initial_params(spark, WIDTH, 7)).df)
    assert run.params.first()["coef"] == initial_params(spark, WIDTH, 7).first()["coef"]


def test_the_prepared_table_is_reused(spark, data, tmp_path):
    cfg = LinearConfig(clients=3, rounds=1, local_epochs=1)
    features = [f"f{i}" for i in range(WIDTH)]
    first = run_linear(_observations(data), features, cfg, "key", cache_dir=str(tmp_path), source="data")
    # Empty input: everything the second run sees comes from the stored table.
    again = run_linear(_observations(data).where("key < 300"), features, cfg, "key", cache_dir=str(tmp_path), source="data")
    assert first.params.first()["coef"] == pytest.approx(again.params.first()["coef"], abs=1e-12)


def test_latest_global_model_is_the_start(spark):
    stats = spark.createDataFrame([(0,)], "client_id int")
    schema = "round int, client_id int, n_examples long, status string, coef array<double>, intercept double"
    params = spark.createDataFrame([(r, None, 1, "ok", [float(r)], 0.0) for r in (1, 3, 2)], schema)
    assert linear.start_from(stats, params).first()["coef"] == [3.0]
    failed = spark.createDataFrame([(4, 0, 1, "failed", [9.0], 0.0)], schema)
    assert [(r["round"], r["coef"]) for r in aggregate.fedavg(failed, params).collect()] == [(4, [3.0])]


def test_features_of_zeros_fail_instead_of_dividing(spark):
    train = spark.createDataFrame([(0, 0, [0.0]), (0, 1, [0.0]), (1, 0, [1.0]), (1, 1, [2.0])], "client_id int, label int, x array<double>")
    made = linear.learner("logistic", "l2", 2, fit_intercept=False)
    assert {r["client_id"]: r["status"] for r in linear.client_stats(train, made).collect()} == {0: "failed", 1: "ok"}
