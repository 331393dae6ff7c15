"""What the physical plans must not contain."""

from __future__ import annotations

import re

import pytest

from shardwise.catalog.inputs import FEATURES, KEY, events
from shardwise.catalog.queries import QUERIES
from shardwise.config import LinearConfig
from shardwise.operators import sampling
from shardwise.operators.ranking import cutoffs
from shardwise.plans.linear_job import prepare_clients
from shardwise.sources.observations import incomplete_vectors, labelled_vectors

PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups|PythonMapInArrow|FlatMapGroupsInArrow")
# Training, tree scoring and the block product of evaluation are the only Python in any plan.
TRAINED = {"evaluate_clients", "evaluate_central", "whole_client_fit", "sequential_fit", "tree_scores", "forest_proba", "evaluate_forest", "forest_scorecard", "prune_forest", "merge_and_prune"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "iid_partition", "stratified_split", "undersample", "oversample", "class_balance", "confusion", "weighted_metrics", "scaler_apply",
    "evaluate_clients", "decision_value", "fedavg", "forest_proba_small", "tree_scores", "logistic_epoch", "random_split", "binary_metrics",
])
def test_plan(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in TRAINED:
        assert not PYTHON.search(text)


def test_assigning_clients_moves_no_rows(spark, sf_dir):
    """Partitioning, undersampling and splitting are lookups and filters on the scan: no shuffle."""
    for name in ("iid_partition", "undersample", "stratified_split", "prepared_clients"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "Exchange hashpartitioning" not in text and "SinglePartition" not in text, name


def test_scans_read_what_is_needed(spark, sf_dir):
    text = plan(QUERIES["iid_partition"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint>" in text


def test_one_pass_scores_all_rounds(spark, sf_dir):
    text = plan(QUERIES["evaluate_clients"](spark, sf_dir))
    assert text.count("FileScan parquet") == 1


@pytest.mark.parametrize("balance", ["undersample", "oversample", "none"])
def test_counting_reads_only_keys_and_labels(spark, sf_dir, monkeypatch, balance):
    counted = []

    def spy(df, *rest, **named):
        counted.append(df)
        return cutoffs(df, *rest, **named)

    monkeypatch.setattr(sampling, "cutoffs", spy)
    prepare_clients(events(spark, sf_dir), FEATURES, LinearConfig(clients=3, balance=balance), KEY)
    assert len(counted) >= 2
    assert all("/keys-" in file for df in counted for file in df.inputFiles())


def test_an_incomplete_row_ends_the_job_or_is_left_out(spark):
    rows = spark.createDataFrame([(1, 1.0, 0), (2, None, 1), (3, float("inf"), 1), (None, 1.0, 0), (5, 2.0, None)], "k long, v double, label int")
    with pytest.raises(Exception, match="incomplete row"):
        labelled_vectors(rows, ["v"], "k").collect()
    assert [r["k"] for r in labelled_vectors(rows, ["v"], "k", on_incomplete="drop").collect()] == [1]
    assert incomplete_vectors(rows, ["v"], "k").first()["incomplete"] == 4
