"""Federated logistic regression and linear SVM: prepare once, then one fit job per round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shardwise.config import LOG_METRICS, LinearConfig
from shardwise.functions.schedules import epochs_in_round
from shardwise.operators.aggregate import aggregate_metrics, fedavg
from shardwise.operators.evaluate import TALLY_SCHEMA, central_names, client_tallies, merge_tallies, metrics_from
from shardwise.operators.linear import CLIENT_ROWS, client_limit, client_stats, fits_tasks, initial_params, learner, local_fit
from shardwise.operators.sampling import balanced_split, iid_partition, partition_bounds, sample_clients
from shardwise.operators.scaling import apply_scaler, fit_scaler
from shardwise.operators.sgd import local_sgd
from shardwise.sources.observations import incomplete_vectors, labelled_vectors, prepared, prepared_before
from shardwise.sources.manifest import begin_run, commit_round, committed_round, read_rounds, run_key, write_round
from shardwise.sources.rounds import write_round_log
from shardwise.sources.scratch import Settled, scratch_dir, settle
from shardwise.sources.state import PARAMS_SCHEMA, read_params, write_params


@dataclass(frozen=True)
class LinearRun:
    """What a run leaves behind, all as tables. The central metrics begin with the starting model, as round 0.

    failures: client_id, reason of every client that has not trained. incomplete: rows, incomplete; counted when read.
    """

    params: DataFrame
    client_metrics: DataFrame
    round_metrics: DataFrame
    central_metrics: DataFrame
    failures: DataFrame
    incomplete: DataFrame


def prepare_clients(
    df: DataFrame, features: list[str], cfg: LinearConfig, key: str, label: str = "label", scaler: DataFrame | None = None, dtype: str = "float"
) -> DataFrame:
    """Partition, standardise, balance and split: (key, client_id, label, x, split).

    One wide pass tests the rows and writes their keys and labels; all hash cutoffs are counted over
    that narrow table. The rows themselves are read for the scaler and once more to be written.
    """
    rows = labelled_vectors(df, features, key, label, dtype, cfg.on_incomplete)
    parts, counted = dealt(rows, key, cfg.clients, cfg.seed)
    scaler = scaler if scaler is not None else fit_scaler(parts, features, cfg.scaler_scope, x="x")
    scaled = apply_scaler(parts, scaler, features, "x")
    return balanced_split(scaled, cfg.balance, ["client_id"], "label", [key], cfg.ratio, cfg.test_fraction, cfg.seed, counted)


def dealt(rows: DataFrame, key: str, clients: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to clients, and the written table of their keys and labels dealt likewise."""
    path = scratch_dir(rows.sparkSession, "keys")
    rows.select(key, "label").write.parquet(path)
    narrow = rows.sparkSession.read.parquet(path)
    bounds = partition_bounds(narrow, [key], clients, seed)
    whole, counted = (iid_partition(t, [key], clients, seed, bounds) for t in (rows, narrow))
    return whole, counted


def run_linear(
    df: DataFrame,
    features: list[str],
    cfg: LinearConfig,
    key: str,
    label: str = "label",
    out_dir: str | None = None,
    cache_dir: str | None = None,
    source: str | None = None,
    start: DataFrame | None = None,
    step: float | None = None,
    dtype: str = "float",
    resume: bool = False,
) -> LinearRun:
    """Run all rounds and return parameters, metrics per client and round, and central metrics.

    The models of all rounds are evaluated together in one pass over the test rows. With `out_dir` each round is evaluated
    after its training; its parameters, tallies and the log of all rounds so far are written before it is committed and the
    next begins. With `resume` a run in `out_dir` goes on after its last committed round (see sources.manifest) and ends
    with the same tables as one that was never cut off.
    """
    spark = df.sparkSession
    made = learner(cfg.loss, cfg.penalty, cfg.local_epochs, l1_ratio=cfg.l1_ratio, fit_intercept=cfg.fit_intercept, tol=cfg.tol)
    known = dict(
        source=source, clients=cfg.clients, balance=cfg.balance, ratio=cfg.ratio, seed=cfg.seed, test=cfg.test_fraction,
        scaler=cfg.scaler_scope, features=tuple(features), label=label, dtype=dtype, key=key, on_incomplete=cfg.on_incomplete,
    )
    # Only a named source can be found again; other runs write to scratch space of their own.
    folder = cache_dir if cache_dir and source else scratch_dir(spark, "run")
    stored = prepared_before(spark, folder, **known)
    if stored is None:
        stored = prepared(prepare_clients(df, features, cfg, key, label, dtype=dtype), folder, **known)
    train = stored.where(F.col("split") == "train").select("client_id", "label", "x", *_keys(stored, key))
    test = stored.where(F.col("split") == "test")
    stats = settle(client_stats(train, made), limit=CLIENT_ROWS)
    if fits_tasks(stats, len(features)):
        # Each client's rows are brought together once; every round then trains without a shuffle.
        spread = min(cfg.clients, int(spark.conf.get("spark.sql.shuffle.partitions")))
        train = train.repartition(spread, "client_id").persist(StorageLevel.MEMORY_AND_DISK)
    # Larger clients are read from their own folders in every epoch; a cached copy would only fill disks.
    try:
        plan = _participants(stats.df, cfg)
        fitting: dict[int, list[int]] = {}
        for row in plan.records() if plan.small else []:
            if row["purpose"] == "fit":
                fitting.setdefault(row["round"], []).append(row["client_id"])
        model = settle(start if start is not None else initial_params(spark, len(features), cfg.seed, cfg.fit_intercept))
        identity, done = run_key(cfg, features=tuple(features), key=key, label=label, source=source, step=step, dtype=dtype), 0
        if out_dir and resume:
            done = committed_round(spark, out_dir, identity)
        elif out_dir:
            begin_run(spark, out_dir, identity)
        history, begin = [], settle(model.df.withColumn("round", F.lit(0)).select(*PARAMS_SCHEMA.names))
        if out_dir and not done:
            write_round(client_tallies(test, begin, cfg.loss), f"{out_dir}/tallies", 0)
        if done:  # a row of weights per finished round
            history = sorted((r.asDict() for r in read_params(spark, f"{out_dir}/params").where(F.col("round") <= done).collect()), key=lambda r: r["round"])
            model = settle(spark.createDataFrame(history[-1:], PARAMS_SCHEMA))
        for round_no in range(done + 1, cfg.rounds + 1):
            hook = cfg.on_round(round_no) if cfg.on_round else {}
            chosen = fitting.get(round_no, []) if plan.small else _fitting(plan.df, round_no)
            if chosen:
                part = train.where(F.col("client_id").isin(chosen))
                mine = stats.only("client_id", chosen)
                epochs = hook.get("epochs", epochs_in_round(round_no, made.epochs, made.loss))
                if cfg.learner == "sequential":
                    schedule = hook.get("schedule", cfg.schedule)
                    local = local_sgd(part, model, made, _keys(stored, key), cfg.seed, epochs, mine, schedule, round_no)
                else:
                    local = local_fit(part, model, made, epochs, mine, step=hook.get("step", step), round_no=round_no)
                merged = settle(fedavg(settle(local, limit=client_limit(len(features))).df, accept_failures=cfg.accept_failures))
                # Without a usable client the previous model goes on.
                model = merged if merged.records() else model
            history.extend({**row, "round": round_no} for row in model.records())
            if out_dir:
                write_params(model.df, f"{out_dir}/params", round_no)
                write_round(client_tallies(test, settle(model.df.withColumn("round", F.lit(round_no))), cfg.loss), f"{out_dir}/tallies", round_no)
                models = begin.df.unionByName(spark.createDataFrame(history, PARAMS_SCHEMA))
                _, by_round, central = _metrics(read_rounds(spark, f"{out_dir}/tallies", TALLY_SCHEMA, round_no), test, models, plan.df, cfg)
                write_round_log(by_round, f"{out_dir}/log")
                write_round_log_central(central, out_dir)
                commit_round(spark, out_dir, identity, round_no)
        run = _evaluated(history, begin.df, test, plan.df, cfg, out_dir)
        return LinearRun(*run, _failures(stats.df, cfg), incomplete_vectors(df, features, key, label, dtype))
    finally:
        train.unpersist()


def _participants(stats: DataFrame, cfg: LinearConfig) -> Settled:
    """Clients chosen for fitting and evaluation in every round, in one table."""
    rounds = list(range(1, cfg.rounds + 1))
    fit = sample_clients(stats, cfg.fit_fraction, cfg.min_clients, rounds, cfg.seed, cfg.min_available, "fit")
    evaluate = sample_clients(stats, cfg.evaluate_fraction, cfg.min_clients, rounds, cfg.seed, cfg.min_available, "evaluate")
    return settle(
        fit.withColumn("purpose", F.lit("fit")).unionByName(evaluate.withColumn("purpose", F.lit("evaluate"))), limit=1_000_000
    )


def _fitting(plan: DataFrame, round_no: int) -> list[int]:
    """The clients that train in one round of a plan too large for the driver."""
    return [r["client_id"] for r in plan.where((F.col("round") == round_no) & (F.col("purpose") == "fit")).select("client_id").collect()]


def _keys(stored: DataFrame, key: str) -> list[str]:
    """The columns that name a row: oversampled rows also carry a copy number."""
    return [c for c in (key, "copy") if c in stored.columns]


def _evaluated(history: list[dict], begin: DataFrame, test: DataFrame, plan: DataFrame, cfg: LinearConfig, out_dir: str | None) -> tuple[DataFrame, ...]:
    # One global model per round: rounds x (features + 1) numbers.
    spark = test.sparkSession
    params = settle(spark.createDataFrame(history, PARAMS_SCHEMA)).df
    models = settle(begin.unionByName(params))
    if out_dir:
        tallies = read_rounds(spark, f"{out_dir}/tallies", TALLY_SCHEMA, cfg.rounds)
    else:
        tallies = settle(client_tallies(test, models, cfg.loss), limit=1_000_000).df
    return params, *_metrics(tallies, test, models.df, plan, cfg)


def _metrics(tallies: DataFrame, test: DataFrame, models: DataFrame, plan: DataFrame, cfg: LinearConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics per client and round, per round, and of the central clients per round, there with the starting model as round 0."""
    asked = plan.where(F.col("purpose") == "evaluate").drop("purpose")
    clients = metrics_from(tallies.join(asked, ["round", "client_id"], "left_semi"), ["round", "client_id"])
    by_round = cfg.aggregate_fn(clients) if cfg.aggregate_fn else aggregate_metrics(clients, LOG_METRICS)
    near = F.col("client_id").isin(*cfg.central_clients)
    if cfg.central_fn:
        central = cfg.central_fn(test.where(near), models)
    else:
        central = central_names(metrics_from(merge_tallies(tallies.where(near), ["round"]), ["round"]))
    return clients, settle(by_round).df, central


def _failures(stats: DataFrame, cfg: LinearConfig) -> DataFrame:
    """Clients that cannot train: balancing or splitting left them no rows, or their rows allow no step."""
    every = stats.sparkSession.range(cfg.clients).select(F.col("id").cast("int").alias("client_id"))
    reason = F.when(F.col("status").isNull(), "no training rows").when(F.col("status") != "ok", "one class or no step")
    return every.join(stats.select("client_id", "status"), "client_id", "left").select("client_id", reason.alias("reason")).where("reason is not null")


def write_round_log_central(central: DataFrame, out_dir: str) -> None:
    """The central metrics beside the log of the clients."""
    central.orderBy("round").coalesce(1).write.mode("overwrite").json(f"{out_dir}/central")
