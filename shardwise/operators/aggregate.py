"""Combining what clients report: parameters by weight, metrics by test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.config import METRICS
from shardwise.sources.state import PARAMS_SCHEMA


def fedavg(params: DataFrame, previous: DataFrame | None = None, accept_failures: bool = True) -> DataFrame:
    """Average of client parameters weighted by training rows, one global row per round.

    Failed clients are left out. A round where none survives (or where one failed and failures are
    not accepted) gives the previous model, if one is passed, under the round's number.
    """
    # The intercept rides along as the last position: one aggregation per position, one to regroup.
    entries = params.selectExpr(
        "round", "status = 'ok' AS ok", "n_examples", "posexplode(concat(coef, array(intercept))) AS (i, w)"
    )
    sums = entries.groupBy("round", "i").agg(
        F.expr("sum(CAST(n_examples AS DOUBLE) * w) FILTER (WHERE ok) / sum(n_examples) FILTER (WHERE ok) AS w"),
        F.expr("sum(n_examples) FILTER (WHERE ok) AS n_examples"),
        F.expr("count_if(ok) AS good"),
        F.expr("count_if(NOT ok) AS bad"),
    )
    rounds = sums.groupBy("round").agg(
        F.expr("transform(sort_array(collect_list(struct(i, w))), e -> e.w) AS weights"),
        F.expr("max(n_examples) AS n_examples"), F.expr("max(good) AS good"), F.expr("max(bad) AS bad"),
    )
    usable = F.expr("good > 0" if accept_failures else "good > 0 AND bad = 0")
    merged = rounds.where(usable).selectExpr(
        "round", "CAST(NULL AS INT) AS client_id", "n_examples", "'ok' AS status",
        "slice(weights, 1, size(weights) - 1) AS coef", "element_at(weights, -1) AS intercept",
    )
    if previous is None:
        return merged
    kept = previous.where(F.col("client_id").isNull()).orderBy(F.desc("round")).limit(1).drop("round").withColumn("one", F.lit(1))
    lost = rounds.where(~usable).select("round", F.lit(1).alias("one"))
    return merged.unionByName(lost.join(kept, "one").select(*PARAMS_SCHEMA.names))


def _weighted(value: Column, weight: Column) -> Column:
    """Weighted mean; a missing value counts as 0 and no rows give 0."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(weight * F.coalesce(value, F.lit(0.0))) / total).otherwise(F.lit(0.0))


def aggregate_metrics(client_metrics: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """Mean of the metrics over clients, weighted by test rows, per round."""
    weight = F.col("n_examples").cast("double")
    return client_metrics.groupBy("round").agg(*[_weighted(F.col(m), weight).alias(m) for m in names])


def aggregate_accuracy(client_metrics: DataFrame) -> DataFrame:
    """The forest job's form: accuracy only."""
    return aggregate_metrics(client_metrics, ("accuracy",))


def aggregate_loss(client_metrics: DataFrame) -> DataFrame:
    """Mean loss weighted by test rows, per round."""
    return aggregate_metrics(client_metrics, ("loss",))
