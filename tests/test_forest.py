"""Forests as node tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shardwise.config import ForestConfig
from shardwise.functions.hashing import hash_order, normal
from shardwise.operators import evaluate, forest, forest_fit, ranking
from shardwise.plans import forest_job
from shardwise.plans.forest_job import run_forest
from shardwise.sources.scratch import scratch_dir, settle
from shardwise.sources.state import NODES_SCHEMA


@pytest.fixture(scope="module")
def data(spark):
    x = F.array(*[normal(hash_order(5, f"f{i}", "key")) for i in range(3)])
    rows = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("client_id"))
    return rows.withColumn("x", x).withColumn("label", ((F.col("x")[0] > 0.2) & (F.col("x")[1] < 0.7)).cast("int")).persist()


def labelled_vectors(df):
    return df.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))


@pytest.fixture(scope="module")
def model(data):
    return RandomForestClassifier(numTrees=12, maxDepth=3, seed=1, featureSubsetStrategy="sqrt").fit(labelled_vectors(data))


@pytest.fixture(scope="module")
def nodes(spark, model):
    return settle(forest.forest_to_nodes(model, scratch_dir(spark, "f"), 0, 1)).df


def test_nodes_predict_like_the_model(spark, data, model, nodes):
    probability = F.udf(lambda v: float(v[1]), "double")
    theirs = {r["i"]: r["p"] for r in model.transform(labelled_vectors(data)).select(F.hash("features").alias("i"), probability("probability").alias("p")).collect()}
    walked = forest.forest_proba(data, nodes)
    written = data.withColumn("proba", forest.nodes_to_expr(nodes))
    a, b = (sorted(r["proba"] for r in df.collect()) for df in (walked, written))
    assert a == pytest.approx(b, abs=1e-12)
    assert sorted(theirs.values()) == pytest.approx(a, abs=1e-12)


def test_importances_equal_the_model(model, nodes):
    ours = {r["Feature"]: r["Importance"] for r in forest.feature_importance(nodes, ["a", "b", "c"]).collect()}
    assert [ours[n] for n in "abc"] == pytest.approx(list(model.featureImportances.toArray()), abs=1e-12)
    assert sum(ours.values()) == pytest.approx(1.0)


def test_scores_do_not_depend_on_the_number_of_passes(data, nodes, monkeypatch):
    one = {r["tree_id"]: tuple(r) for r in forest.tree_scores(nodes, data).collect()}
    proba = sorted(r["proba"] for r in forest.forest_proba(data, nodes).collect())
    monkeypatch.setattr(forest, "PASS_NODES", 20)
    many = {r["tree_id"]: tuple(r) for r in forest.tree_scores(nodes, data).collect()}
    assert one == many and len(one) == 12
    assert proba == pytest.approx(sorted(r["proba"] for r in forest.forest_proba(data, nodes).collect()), abs=1e-12)


def _stumps(spark, clients):
    """Two one-leaf trees per client; the leaf votes for class `client % 2`."""
    rows = [(1, c, t, 0, -1, None, -1, -1, [1.0, 0.0] if c % 2 == 0 else [0.0, 1.0], -1.0, 1) for c in range(clients) for t in range(2)]
    return spark.createDataFrame(rows, NODES_SCHEMA)


def test_merge_keeps_every_tree_and_pruning_breaks_ties_by_position(spark, data):
    merged = settle(forest.merge_forests(_stumps(spark, 3))).df
    assert sorted(r["tree_id"] for r in merged.collect()) == list(range(6))
    scores = forest.tree_scores(merged, data)
    share = data.agg(F.avg("label")).first()[0]
    found = {r["tree_id"]: r["score"] for r in scores.collect()}
    assert found == pytest.approx({t: share if t in (2, 3) else 1 - share for t in range(6)})
    # Zeros are the majority: trees 0, 1, 4, 5 tie above 2 and 3; the later ones of a tie are kept.
    kept = forest.prune_forest(merged.withColumn("n", F.col("tree_id").cast("long")), scores, 3)
    assert {r["tree_id"]: r["n"] for r in kept.collect()} == {0: 1, 1: 4, 2: 5}
    everything = forest.prune_forest(merged, scores, 100)
    assert everything.select("tree_id").distinct().count() == 6


def test_target_is_half_but_at_least_ten(spark):
    assert tuple(forest.target_trees(_stumps(spark, 3)).first()) == (6, 10)
    assert tuple(forest.target_trees(_stumps(spark, 15)).first()) == (30, 15)


def test_growth_keeps_old_trees(data, nodes):
    own = data.where("client_id = 0")
    grown = settle(forest.grow_forest(nodes, own, 14, 3, 42, 0, 2)).df
    assert grown.select("tree_id").distinct().count() == 14
    old = grown.where("tree_id < 12").drop("round").exceptAll(nodes.drop("round"))
    assert old.count() == 0
    assert forest.grow_forest(nodes, own, 12, 3, 42, 0, 2).select("tree_id").distinct().count() == 12


def test_single_class_client_still_fits(data):
    only = data.where("label = 0")
    grown = forest.fit_forest(only, 2, 3, 1)
    assert forest.forest_proba(only, grown).agg(F.max("proba")).first()[0] == 0.0


def test_fit_per_client(spark, data):
    fitted = forest.fit_forests(data, [0, 1], 3, 2, 42, round_no=1)
    counts = {r["client_id"]: r["t"] for r in fitted.groupBy("client_id").agg(F.count_distinct("tree_id").alias("t")).collect()}
    assert counts == {0: 3, 1: 3}
    assert fitted.agg(F.max(F.size("counts"))).first()[0] == 2


def test_initial_forest(spark):
    start = forest.initial_forest(spark, 3, 4, 2, 1)
    assert start.select("tree_id").distinct().count() == 4
    assert start.where("node_id = 0").agg(F.min("n")).first()[0] > 50


def test_scorecard(data, nodes):
    row = evaluate.forest_scorecard(data, nodes).first()
    missed = forest.forest_proba(data, nodes).where("label = 1").agg(F.avg((F.col("pred") == 0).cast("int"))).first()[0]
    assert row["accuracy"] > 0.9 and row["false_negative_rate"] == pytest.approx(missed)


@pytest.mark.parametrize("legacy", [False, True])
def test_the_job_learns(spark, data, tmp_path, legacy):
    frame = data.select("key", "label", *[F.col("x")[i].alias(n) for i, n in enumerate("abc")])
    cfg = ForestConfig(rounds=2, clients=2, trees=6, legacy_test=legacy, cold_start=not legacy)
    run = run_forest(frame, ["a", "b", "c"], cfg, "key", out_dir=str(tmp_path))
    log = {r["round"]: r for r in run.round_metrics.collect()}
    assert sorted(log) == [1, 2] and log[2]["accuracy"] > 0.85
    assert run.nodes.where("round = 2").select("tree_id").distinct().count() == 6
    from shardwise.sources.state import read_forest

    assert read_forest(spark, f"{tmp_path}/forest").select("round").distinct().count() == 2


def test_a_plan_too_large_for_the_driver_changes_nothing(data, monkeypatch):
    frame = data.select("key", "label", *[F.col("x")[i].alias(n) for i, n in enumerate("abc")])
    cfg = ForestConfig(rounds=2, clients=2, trees=3)
    whole = {tuple(r) for r in run_forest(frame, ["a", "b", "c"], cfg, "key").client_metrics.collect()}
    monkeypatch.setattr(forest_job, "settle", lambda df, limit=None: settle(df, 2 if set(df.columns) == {"round", "client_id"} else limit or 200_000))
    assert {tuple(r) for r in run_forest(frame, ["a", "b", "c"], cfg, "key").client_metrics.collect()} == whole


def test_trees_do_not_depend_on_partitions_chunks_or_task_size(spark, data, monkeypatch):
    plan = spark.createDataFrame([(0, 3, 4), (1, 17, 2), (5, 0, 1)], "client_id int, first int, trees int")
    whole = {tuple(r) for r in forest_fit.fit_trees(data.repartition(1), plan, 3, 7, 2).select(*NODES_SCHEMA.names).drop("counts").collect()}
    apart = {tuple(r) for r in forest_fit.fit_trees(data.repartition(16), plan, 3, 7, 2, chunk_bytes=1).drop("counts").collect()}
    monkeypatch.setattr(forest_fit, "CELLS", 1)
    small = {tuple(r) for r in forest_fit.fit_trees(data, plan, 3, 7, 2).drop("counts").collect()}
    assert whole == apart == small
    trees = {(r[1], r[2]) for r in whole}
    assert trees == {(0, 3), (0, 4), (0, 5), (0, 6), (1, 17), (1, 18), (5, 0)}
    assert [r[3:] for r in whole if r[1] == 5] == [(0, -1, None, -1, -1, -1.0, 0)]  # no rows: a leaf without counts


def test_growing_two_forests_costs_as_many_jobs_as_growing_twenty(spark, data):
    jobs = {}
    for clients in (2, 20):
        rows = data.withColumn("client_id", (F.col("key") % clients).cast("int")).persist()
        rows.count()
        spark.sparkContext.setJobGroup(f"fit-{clients}", "fit")
        forest.fit_forests(rows, range(clients), 3, 3, 1, 1)
        jobs[clients] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{clients}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] == jobs[20]


def test_fitted_trees_learn_and_count_their_rows(data):
    fitted = settle(forest.fit_forests(data, [0, 1], 8, 4, 42, 1)).df
    own = forest.forest_proba(data.where("client_id = 0"), fitted.where("client_id = 0"))
    assert own.agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0] > 0.9
    parents = {(r["client_id"], r["tree_id"], r["node_id"]): r for r in fitted.collect()}
    for (c, t, _), r in parents.items():
        if r["left"] >= 0:
            below = [parents[(c, t, r[side])] for side in ("left", "right")]
            assert [sum(b["counts"][k] for b in below) for k in (0, 1)] == r["counts"] and r["n"] == sum(r["counts"])
            assert min(b["n"] for b in below) > 0 and r["gain"] > 0


def _random_trees(spark, trees, depth, features, seed=3):
    """Uneven trees with thresholds on a grid, so that values meet thresholds exactly."""
    rng, rows = random.Random(seed), []
    for t in range(trees):
        stack = [(0, 0)]
        while stack:
            node, d = stack.pop()
            leaf = d == depth or rng.random() < 0.1
            rows.append((1, None, t, node, -1 if leaf else rng.randrange(features), None if leaf else float(rng.randint(-3, 3)), -1 if leaf else 2 * node + 1, -1 if leaf else 2 * node + 2, [float(rng.randint(0, 5)), float(rng.randint(0, 5))], -1.0, 1))
            if not leaf:
                stack += [(2 * node + 2, d + 1), (2 * node + 1, d + 1)]
    return rows


def _walk(rows, x):
    by = {}
    for r in rows:
        by.setdefault(r[2], {})[r[3]] = r
    out = np.zeros((len(x), len(by)))
    for t, tree in by.items():
        for i, v in enumerate(x):
            r = tree[0]
            while r[6] >= 0:
                r = tree[r[6] if v[r[4]] <= r[5] else r[7]]
            out[i, t] = r[8][1] / sum(r[8]) if sum(r[8]) else 0.0
    return out


@pytest.mark.parametrize(("trees", "depth", "features", "budget"), [(40, 3, 4, None), (25, 8, 2, None), (60, 5, 9, 40_000), (7, 0, 2, None)])
def test_leaf_masks_equal_walking(spark, trees, depth, features, budget):
    rows = _random_trees(spark, trees, depth, features)
    nodes = spark.createDataFrame(rows, NODES_SCHEMA).collect()
    x = np.random.default_rng(0).integers(-4, 5, (90, features)).astype(float)
    x[5, 0] = np.nan
    ids, score = forest._masked(nodes, budget)
    found, largest = np.full((len(x), trees), -1.0), 0
    for at, first, share in score(x):
        found[at : at + len(share), first : first + share.shape[1]] = share
        largest = max(largest, share.nbytes)
    assert ids == list(range(trees)) and (found == _walk(rows, x)).all()
    assert largest <= (budget or forest.MASK_BYTES)


def test_five_thousand_trees_stay_under_the_budget(spark):
    rows = _random_trees(spark, 5000, 3, 20)
    nodes = [dict(zip(NODES_SCHEMA.names, r, strict=True)) for r in rows]
    budget = 8 << 20
    ids, score = forest._masked(nodes, budget)
    x = np.random.default_rng(1).integers(-4, 5, (300, 20)).astype(float)
    seen, total = 0, np.zeros(len(x))
    for at, _, share in score(x):
        assert share.nbytes <= budget
        seen += share.size
        total[at : at + len(share)] += share.sum(axis=1)
    tables = [c.cell_contents for c in score.__closure__ if isinstance(c.cell_contents, list) and len(c.cell_contents) == 2][0]
    assert sum(allowed.nbytes for _, _, parts in tables[1] for *_, allowed in parts) <= budget
    assert len(ids) == 5000 and seen == 300 * 5000
    assert total[:3] == pytest.approx(_walk(rows, x[:3]).sum(axis=1))


def test_numbering_is_the_same_where_no_task_sees_a_group(spark):
    rng = random.Random(1)
    rows = [(k % 3, rng.choice([None, 1, 2, 3]), rng.randint(0, 4), k) for k in range(400)]
    df = spark.createDataFrame(rows, "r int, c int, s int, t int").repartition(7)
    for by, order in ((["r"], [("c", "ascending"), ("t", "ascending")]), ([], [("s", "descending"), ("t", "descending")])):
        small, large = ranking.numbered(df, by, order, "place"), ranking.numbered(df, by, order, "place", limit=10)
        assert small.small and not large.small
        assert sorted(map(tuple, small.df.collect()), key=repr) == sorted(map(tuple, large.df.select(*df.columns, "place").collect()), key=repr)
        assert "Window" not in large.df._jdf.queryExecution().toString()


def test_pruning_without_a_local_table_keeps_the_same_trees(spark, data, nodes, monkeypatch):
    merged = settle(forest.merge_forests(nodes)).df
    scores = settle(forest.tree_scores(merged, data)).df
    one = {tuple(r) for r in forest.prune_forest(merged, scores, 5).drop("counts").collect()}
    monkeypatch.setattr(forest, "numbered", lambda *a, **k: ranking.numbered(*a, **k, limit=2))
    assert {tuple(r) for r in forest.prune_forest(merged, scores, 5).drop("counts").collect()} == one
    assert {tuple(r) for r in forest.merge_forests(nodes).drop("counts").collect()} == {tuple(r) for r in merged.drop("counts").collect()}
