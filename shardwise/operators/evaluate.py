"""Scoring test rows and turning them into metrics.

Every evaluation is one pass: rows are scored, and only counts and loss sums per group are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardwise.config import LOG_METRICS, METRICS
from shardwise.operators.forest import forest_proba
from shardwise.functions.linear import UNROLL, decision, predicted_class, probability
from shardwise.functions.metrics import CLIP, confusion_counts, hinge_row, log_loss_row, metric_columns
from shardwise.sources.scratch import Settled, settle

# Models read to the driver at once when they are few, and bytes of weights that travel with one pass.
MODEL_ROWS = 10_000
MODEL_BYTES = 16 << 20
# Counts and losses of one (round, client), which larger groups add up.
TALLY_SCHEMA = (
    StructType().add("round", "integer").add("client_id", "integer").add("tn", "long").add("fp", "long").add("fn", "long")
    .add("tp", "long").add("loss_sum", "double").add("loss_rows", "long")
)
# (round, group) sums a task holds before it passes them on.
GROUPS = 500_000


def score(df: DataFrame, loss: str, width: int | None = None) -> DataFrame:
    """Add decision, proba and pred from columns x, coef and intercept."""
    f = decision(F.col("x"), F.col("coef"), F.col("intercept"), width)
    return (
        df.withColumn("decision", f)
        .withColumn("proba", probability(F.col("decision"), loss))
        .withColumn("pred", predicted_class(F.col("decision")))
        .drop("coef", "intercept")
    )


def confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """TN, FP, FN and TP per group."""
    counts = confusion_counts(F.col("label"), F.col("pred"))
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])


def hinge_loss(scored: DataFrame, by: list[str], signed: bool = False) -> DataFrame:
    """Mean hinge loss per group."""
    return scored.groupBy(*by).agg(F.avg(hinge_row(F.col("label"), F.col("decision"), signed)).alias("loss"))


def log_loss(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean log loss per group, probabilities clipped away from 0 and 1."""
    return scored.groupBy(*by).agg(F.avg(log_loss_row(F.col("label"), F.col("proba"))).alias("loss"))


def tally(scored: DataFrame, by: list[str], loss: str = "log_loss", signed: bool = False) -> DataFrame:
    """Mergeable sums per group: the four counts, the loss sum and the rows that had a loss."""
    row = hinge_row(F.col("label"), F.col("decision"), signed) if loss == "hinge" else log_loss_row(F.col("label"), F.col("proba"))
    counts = [c.alias(n) for n, c in confusion_counts(F.col("label"), F.col("pred")).items()]
    return scored.withColumn("row_loss", row).groupBy(*by).agg(
        *counts, F.sum("row_loss").alias("loss_sum"), F.count("row_loss").alias("loss_rows")
    )


def merge_tallies(tallies: DataFrame, by: list[str]) -> DataFrame:
    """Tallies of larger groups from those of smaller ones."""
    return tallies.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp", "loss_sum", "loss_rows")])


def metrics_from(tallies: DataFrame, by: list[str], average: str = "auto") -> DataFrame:
    """Rows, loss and the six metrics. Where a group has no usable loss, it is 1 - accuracy."""
    rows = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    columns = metric_columns(average)
    whole = F.col("loss_rows") == rows
    mean = F.when(whole & (rows > 0), F.col("loss_sum") / F.col("loss_rows"))
    return tallies.select(
        *by, rows.alias("n_examples"),
        F.coalesce(mean, F.lit(1.0) - columns["accuracy"]).alias("loss"),
        *[columns[m].alias(m) for m in METRICS],
    )


def metrics(scored: DataFrame, by: list[str], loss: str = "log_loss", average: str = "auto", signed: bool = False) -> DataFrame:
    """All metrics of a scored table per group, in one pass."""
    return metrics_from(tally(scored, by, loss, signed), by, average)


def _model_slices(params: Settled) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rounds, weights (features x rounds) and intercepts of some global models at a time, MODEL_BYTES of them at most."""
    rows = params.records() if params.small else (r.asDict() for r in params.df.select("round", "coef", "intercept").orderBy("round").toLocalIterator())
    held: list[dict] = []

    def made() -> tuple[list[int], np.ndarray, np.ndarray]:
        return [r["round"] for r in held], np.array([r["coef"] for r in held]).T, np.array([r["intercept"] or 0.0 for r in held])

    for r in rows:
        if held and (len(held) + 1) * (len(r["coef"]) + 1) * 8 > MODEL_BYTES:
            yield made()
            held = []
        held.append(r)
    if held:
        yield made()


def round_tallies(test: DataFrame, params: DataFrame | Settled, loss: str, by: str | None = "client_id") -> DataFrame:
    """Tallies of every global model in `params` on the test rows, per round and `by`.

    A task multiplies each batch of rows with the matrix of all rounds' weights and adds up counts and losses per (round,
    `by`); only those are shuffled. No row is repeated per round, and the rows are read once for each MODEL_BYTES of weights.
    """
    if not isinstance(params, Settled):
        params = settle(params.where(F.col("client_id").isNull()), limit=MODEL_ROWS)
    groups = ["round", by] if by else ["round"]
    columns = [by] if by else []
    kind = test.schema[by].dataType.simpleString() if by else ""
    rows = test.select(F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x"), *columns)
    parts = [rows.mapInArrow(_tallies(*models, loss, by), f"round int, {f'{by} {kind}, ' if by else ''}tn long, fp long, fn long, tp long, loss_sum double, loss_rows long") for models in _model_slices(params)]
    if not parts:
        raise ValueError("no global model to evaluate")
    return merge_tallies(reduce(DataFrame.unionByName, parts), groups)


def _tallies(rounds: list[int], weights: np.ndarray, intercepts: np.ndarray, loss: str, by: str | None):
    clip, groups_held, unrolled = CLIP, GROUPS, UNROLL

    def decisions(x):
        if x.shape[1] > unrolled:
            return x @ weights + intercepts
        total = np.broadcast_to(intercepts, (len(x), len(rounds)))
        for i in range(x.shape[1]):  # term by term, as a single score is written
            total = total + x[:, i : i + 1] * weights[i]
        return total

    def costs(y, f):
        if loss == "hinge":
            return np.maximum(0.0, 1.0 - y * f)
        p = (np.clip(f, -1.0, 1.0) + 1.0) / 2.0 if loss == "modified_huber" else 1.0 / (1.0 + np.exp(-f))
        p = np.clip(p, clip, 1.0 - clip)
        return -np.log(np.where(y == 1, p, 1.0 - p))

    def run(batches):
        held: dict = {}

        def passed_on():
            for group, sums in held.items():
                own = [pa.array([group] * len(rounds), kind)] if by else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rounds, pa.int32()), *own, *[pa.array(sums[k].astype(np.int64)) for k in range(4)], pa.array(sums[4]), pa.array(sums[5].astype(np.int64))],
                    ["round", *([by] if by else []), "tn", "fp", "fn", "tp", "loss_sum", "loss_rows"],
                )
            held.clear()

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy()[:, None]
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                f = decisions(batch.column(1).flatten().to_numpy().reshape(len(y), -1))
                cost = costs(y, f)
            positive = (f > 0) | np.isnan(f)
            usable = ~np.isnan(cost) if loss != "hinge" else np.ones(cost.shape, bool)
            cells = [(y == 0) & ~positive, (y == 0) & positive, (y == 1) & ~positive, (y == 1) & positive, np.where(usable, cost, 0.0), usable]
            if by:
                kind = batch.column(2).type
                names = batch.column(2).dictionary_encode()
                code = names.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
                groups = [names.dictionary[int(c)].as_py() for c in code[order][starts]]
                sums = [np.add.reduceat(c[order].astype(np.float64), starts, axis=0) for c in cells]
            else:
                groups, sums = [None], [c.sum(axis=0, dtype=np.float64)[None] for c in cells]
            for g, group in enumerate(groups):
                held[group] = held.get(group, 0.0) + np.stack([c[g] for c in sums])
            if len(held) * len(rounds) > groups_held:
                yield from passed_on()
        yield from passed_on()

    return run


def client_tallies(test: DataFrame, params: DataFrame | Settled, loss: str) -> DataFrame:
    """Tallies per (round, client) of the global models on the clients' test rows."""
    return round_tallies(test, params, loss)


def evaluate_clients(test: DataFrame, params: DataFrame, loss: str) -> DataFrame:
    """Metrics of the global model on each client's own test rows, per round."""
    return metrics_from(client_tallies(test, params, loss), ["round", "client_id"])


def evaluate_central(test: DataFrame, params: DataFrame, loss: str) -> DataFrame:
    """Metrics of the global model on one central test set, names prefixed `central_`."""
    return central_names(metrics_from(round_tallies(test, params, loss, None), ["round"]))


def central_names(table: DataFrame) -> DataFrame:
    """The `central_` names of a metrics table."""
    return table.select("round", "n_examples", *[F.col(m).alias(f"central_{m}") for m in LOG_METRICS])


def evaluate_forest(test: DataFrame, nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, log loss and accuracy of a forest per client."""
    by = ["client_id"] if by is None else by
    return metrics(forest_proba(test, nodes), by).select(*by, "n_examples", "loss", "accuracy")


def forest_scorecard(test: DataFrame, nodes: DataFrame) -> DataFrame:
    """The seven metrics of a forest on one test set, in one row."""
    one = metrics(forest_proba(test, nodes).withColumn("scope", F.lit(0)), ["scope"])
    return one.select("accuracy", "precision", "recall", "f1_score", "loss", "false_positive_rate", "false_negative_rate")
