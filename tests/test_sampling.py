"""Partitions, splits and draws: exact sizes, skewed groups, repeatability."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shardwise.operators import sampling
from shardwise.operators.ranking import cutoffs, distributed_rank, position_key


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_partition_is_complete_and_even(spark, skewed):
    parts = sampling.iid_partition(skewed.drop("client_id"), ["key"], 7, 1)
    counts = {r["client_id"]: r["count"] for r in parts.groupBy("client_id").count().collect()}
    assert [counts[c] for c in range(7)] == [129] * 4 + [128] * 3
    assert parts.select("key").distinct().count() == 900


@pytest.mark.parametrize("clients", [1, 200, 300, 900])
def test_partition_of_any_number(spark, skewed, clients):
    counts = sampling.iid_partition(skewed.drop("client_id"), ["key"], clients, 1).groupBy("client_id").count()
    assert counts.count() == clients
    assert counts.agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_results_do_not_depend_on_partitioning(spark, skewed):
    other = skewed.orderBy(F.col("label"), F.desc("key")).repartition(3)
    for split in (
        lambda d: sampling.stratified_split(d, ["client_id"], "label", ["key"], 0.2, 5),
        lambda d: sampling.undersample(d, ["client_id"], "label", ["key"], 1.0, 5).withColumn("split", F.lit("-")),
    ):
        assert _rows(split(skewed), "key", "split") == _rows(split(other), "key", "split")


def test_deeper_counting_finds_the_same_cutoffs(spark, skewed):
    def middle(sizes):
        return sizes.withColumn("r", F.floor(F.col("n") / 2))

    flat = cutoffs(skewed, ["client_id"], ["key"], 3, "t", middle)
    deep = cutoffs(skewed, ["client_id"], ["key"], 3, "t", middle, sort_rows=0)
    assert _rows(flat.df, "client_id", "r", "cut") == _rows(deep.df, "client_id", "r", "cut")
    ranked = distributed_rank(skewed, ["client_id"], ["key"], 3, "t").withColumn("pos", position_key(3, "t", ["key"]))
    sizes = skewed.groupBy("client_id").count().withColumn("rank", F.floor(F.col("count") / 2))
    assert _rows(flat.df, "client_id", "r", "cut") == _rows(ranked.join(sizes, ["client_id", "rank"]), "client_id", "rank", "pos")


def test_rank_numbers_every_row_once(spark, skewed):
    ranked = distributed_rank(skewed, ["client_id"], ["key"], 9, "r")
    bad = ranked.groupBy("client_id").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("rank").alias("d"))
    assert bad.where((F.col("n") != F.col("top")) | (F.col("n") != F.col("d"))).count() == 0


def test_splits_have_exact_sizes(spark, skewed):
    tests = sampling.random_split(skewed, ["key"], 0.23, 4).where("split = 'test'").count()
    assert tests == 207
    ordered = sampling.ordered_split(skewed, ["client_id"], ["key"], 0.8, 4).groupBy("client_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("train")
    )
    assert ordered.where(F.col("train") != F.floor(0.8 * F.col("n"))).count() == 0


def test_stratified_split_marks_hopeless_groups(spark):
    rows = [(0, k, int(k < 2), k) for k in range(10)] + [(1, 100 + k, int(k == 0), k) for k in range(3)]
    df = spark.createDataFrame(rows, "client_id int, key bigint, label int, x int")
    found = {(r["client_id"], r["split"]): r["count"] for r in sampling.stratified_split(df, ["client_id"], "label", ["key"], 0.2, 1).groupBy("client_id", "split").count().collect()}
    assert found == {(0, "test"): 2, (0, "train"): 8, (1, None): 3}


@pytest.mark.parametrize("ratio", [0.5, 1.0, 50.0])
def test_undersample_counts(spark, skewed, ratio):
    before = {r["client_id"]: r for r in skewed.groupBy("client_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()}
    after = sampling.undersample(skewed, ["client_id"], "label", ["key"], ratio, 8).groupBy("client_id").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    for r in after.collect():
        positives = before[r["client_id"]]["p"]
        assert r["p"] == positives
        assert r["n"] - r["p"] == min(before[r["client_id"]]["n"] - positives, int(positives * ratio))


@pytest.mark.parametrize("ratio", [0.5, 2.5])
def test_oversample_counts(spark, skewed, ratio):
    positives = {r["client_id"]: r["p"] for r in skewed.groupBy("client_id").agg(F.sum("label").alias("p")).collect()}
    drawn = sampling.oversample(skewed, ["client_id"], "label", ["key"], ratio, 8)
    assert drawn.select("client_id", "key", "copy").distinct().count() == drawn.count()
    assert drawn.where("label = 0").count() == skewed.where("label = 0").count()
    for r in drawn.where("label = 1").groupBy("client_id").count().collect():
        assert r["count"] == int(positives[r["client_id"]] * ratio)


@pytest.mark.parametrize("ratio", [1.0, 0.5])
def test_balanced_split_is_both_steps(spark, skewed, ratio):
    by, key = ["client_id"], ["key"]
    together = sampling.balanced_split(skewed, "undersample", by, "label", key, ratio, 0.2, 6)
    kept = sampling.undersample(skewed, by, "label", key, ratio, 6)
    apart = sampling.stratified_split(kept, by, "label", key, 0.2, 6, purpose="undersample")
    as_text = F.coalesce("split", F.lit("none")).alias("split")
    assert _rows(together.select("key", as_text), "key", "split") == _rows(apart.select("key", as_text), "key", "split")


def test_balanced_split_of_oversampled_rows(spark, skewed):
    split = sampling.balanced_split(skewed, "oversample", ["client_id"], "label", ["key"], 2.0, 0.2, 6)
    assert split.count() == sampling.oversample(skewed, ["client_id"], "label", ["key"], 2.0, 6).count()
    assert {r["split"] for r in split.select("split").distinct().collect()} == {"train", "test"}


def test_client_sampling(spark):
    clients = spark.range(10).select(F.col("id").cast("int").alias("client_id"))
    chosen = sampling.sample_clients(clients, 0.25, 4, [1, 2, 3], 1).groupBy("round").count().collect()
    assert {r["count"] for r in chosen} == {4}
    assert sampling.sample_clients(clients.limit(1), 1.0, 1, [1], 1, min_available=2).count() == 0


def test_unknown_balance_method(skewed):
    with pytest.raises(ValueError):
        sampling.balance(skewed, "smote", ["client_id"], "label", ["key"], 1.0, 1)


def test_as_many_clients_as_rows_without_a_broadcast(spark, skewed, monkeypatch):
    """900 rows to 900 clients: the same clients by longer prefixes and a shuffled join, and no broadcast of the cutoffs."""
    from shardwise.operators import ranking

    rows = skewed.select("key", "label")
    known = {r["key"]: r["client_id"] for r in sampling.iid_partition(rows, ["key"], 900, 42).collect()}
    assert sorted(known.values()) == list(range(900))
    monkeypatch.setattr(ranking, "CUT_BYTES", 0)
    monkeypatch.setattr(ranking, "CUTS_EACH", 1)
    parts = sampling.iid_partition(rows, ["key"], 900, 42)
    assert {r["key"]: r["client_id"] for r in parts.collect()} == known
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


def test_clients_of_a_round_are_chosen_without_a_window(spark):
    clients = spark.range(40).selectExpr("cast(id as int) client_id")
    chosen = sampling.sample_clients(clients, 0.3, 2, [1, 2, 3], 42)
    assert {r["count"] for r in chosen.groupBy("round").count().collect()} == {12}
    assert "Window" not in chosen._jdf.queryExecution().toString()
    assert sampling.sample_clients(clients.limit(1), 0.3, 2, [1, 2], 42).count() == 0
    assert sampling.sample_clients(clients.limit(0), 0.3, 2, [1], 42, 0).count() == 0
