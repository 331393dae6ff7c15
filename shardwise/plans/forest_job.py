"""Federated random forest: grow per client, merge, prune, evaluate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardwise.config import ForestConfig
from shardwise.functions.schedules import trees_in_round
from shardwise.operators.aggregate import aggregate_metrics
from shardwise.operators.evaluate import evaluate_forest
from shardwise.operators.forest import grow_forests, initial_forest, merge_and_prune
from shardwise.operators.sampling import central_head_test, ordered_split, sample_clients
from shardwise.plans.linear_job import dealt
from shardwise.sources.observations import labelled_vectors, prepared
from shardwise.sources.manifest import begin_run, commit_round, committed_round, read_rounds, run_key, write_round
from shardwise.sources.rounds import write_round_log
from shardwise.sources.scratch import Settled, scratch_dir, settle
from shardwise.sources.state import NODES_SCHEMA, latest, read_forest, write_forest

# Metrics of a forest per client.
CLIENT_SCHEMA = StructType().add("client_id", "integer").add("n_examples", "long").add("loss", "double").add("accuracy", "double").add("round", "integer")


@dataclass(frozen=True)
class ForestRun:
    """The pruned forest of every round and the metrics of the clients."""

    nodes: DataFrame
    client_metrics: DataFrame
    round_metrics: DataFrame


def prepare_forest_clients(df: DataFrame, features: list[str], cfg: ForestConfig, key: str, label: str = "label") -> DataFrame:
    """Partition and split in partition order: (key, client_id, label, x, split). No scaling."""
    rows = labelled_vectors(df, features, key, label, on_incomplete=cfg.on_incomplete)
    parts, counted = dealt(rows, key, cfg.clients, cfg.seed)
    return ordered_split(parts, ["client_id"], [key], cfg.train_fraction, cfg.seed, counted=counted)


def run_forest(
    df: DataFrame, features: list[str], cfg: ForestConfig, key: str, label: str = "label", out_dir: str | None = None, resume: bool = False
) -> ForestRun:
    """Run all rounds. Each round every chosen client keeps the global trees and grows new ones.

    With `out_dir` each round's forest, client metrics and the log of all rounds so far are written before the round is
    committed; with `resume` a run there goes on after its last committed round.
    """
    spark = df.sparkSession
    rows = prepare_forest_clients(df, features, cfg, key, label)
    stored = prepared(rows, scratch_dir(spark, "forest-run"), clients=cfg.clients, seed=cfg.seed, split=cfg.train_fraction)
    train, test = stored.where(F.col("split") == "train"), stored.where(F.col("split") == "test")
    merge_test = central_head_test(stored.drop("split"), [key], 0, 0.2, cfg.seed) if cfg.legacy_test else test
    clients = settle(spark.range(cfg.clients).select(F.col("id").cast("int").alias("client_id"))).df
    rounds = list(range(1, cfg.rounds + 1))
    plan = settle(sample_clients(clients, cfg.fit_fraction, cfg.min_clients, rounds, cfg.seed, cfg.min_available, "fit")).df
    asked = settle(sample_clients(clients, cfg.evaluate_fraction, cfg.min_clients, rounds, cfg.seed, cfg.min_available, "evaluate"))
    identity, done = run_key(cfg, features=tuple(features), key=key, label=label), 0
    if out_dir and resume:
        done = committed_round(spark, out_dir, identity)
    elif out_dir:
        begin_run(spark, out_dir, identity)
    history, metrics = [], []
    if done:
        forests = read_forest(spark, f"{out_dir}/forest").where(F.col("round") <= done)
        history.append(forests)
        metrics.append(read_rounds(spark, f"{out_dir}/client_metrics", CLIENT_SCHEMA, done))
        model = settle(latest(forests)).df
    else:
        model = None if cfg.cold_start else settle(initial_forest(spark, len(features), cfg.trees, cfg.depth, cfg.seed)).df
    for round_no in rounds[done:]:
        hook = cfg.on_round(round_no) if cfg.on_round else {}
        target = hook.get("trees", trees_in_round(round_no))
        # A round's participants at a time: the plan of all rounds may be too large for the driver.
        chosen = sorted(r["client_id"] for r in plan.where(F.col("round") == round_no).select("client_id").collect())
        if chosen:
            grown = settle(grow_forests(model, train, chosen, target, cfg.depth, cfg.seed, round_no, key), limit=1_000_000).df
            model = settle(merge_and_prune(grown, merge_test, cfg.trees)).df
        if model is None:
            continue
        history.append(model.withColumn("round", F.lit(round_no)).select(*NODES_SCHEMA.names))
        mine = Settled(asked.df.where(F.col("round") == round_no).select("client_id"), asked.rows)
        part = test.join(mine.side(), "client_id", "left_semi")
        metrics.append(settle(evaluate_forest(part, model).withColumn("round", F.lit(round_no))).df)
        if out_dir:
            write_forest(model, f"{out_dir}/forest", round_no)
            write_round(metrics[-1], f"{out_dir}/client_metrics", round_no)
            log = aggregate_metrics(read_rounds(spark, f"{out_dir}/client_metrics", CLIENT_SCHEMA, round_no), ("loss", "accuracy"))
            write_round_log(settle(log).df, f"{out_dir}/log")
            commit_round(spark, out_dir, identity, round_no)
    if not history:
        raise ValueError("no round had enough clients")
    client_metrics = reduce(DataFrame.unionByName, metrics)
    return ForestRun(reduce(DataFrame.unionByName, history), client_metrics, aggregate_metrics(client_metrics, ("loss", "accuracy")))
