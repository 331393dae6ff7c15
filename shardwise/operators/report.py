"""Reports over the round log (one row per run and round)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.config import LOG_METRICS

# Metrics where falling is good, and the marks in the summary.
FALLING_IS_GOOD = ("loss", "false_positive_rate", "false_negative_rate")
GOOD, BAD = "✓", "✗"

# The metrics behind each chart.
CHARTS = {
    "learning_curves": ("accuracy", "loss"),
    "precision_recall": ("precision", "recall", "f1_score"),
    "error_rates": ("false_positive_rate", "false_negative_rate"),
    "overview": LOG_METRICS,
}


def _with_run(log: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (log, list(by)) if by else (log.withColumn("run_id", F.lit("run")), ["run_id"])


def summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last round per metric, the difference and its direction mark."""
    rows, groups = _with_run(log, by)
    values = F.struct(*[F.col(m) for m in LOG_METRICS])
    ends = rows.groupBy(*groups).agg(F.min_by(values, "round").alias("a"), F.max_by(values, "round").alias("z"))
    entries = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(m).alias("Metric"), F.col(f"a.{m}").alias("Initial Value"), F.col(f"z.{m}").alias("Final Value"))
        for i, m in enumerate(LOG_METRICS)
    ])
    long = ends.select(*groups, F.explode(entries).alias("e")).select(*groups, "e.*")
    change = F.col("Final Value") - F.col("Initial Value")
    marked = long.withColumn("Improvement", change).withColumn("Change", change_mark(F.col("Metric"), F.col("Improvement")))
    ordered = marked.orderBy(*groups, "place").drop("place")
    return ordered if by else ordered.drop("run_id")


def change_mark(metric: Column, change: Column) -> Column:
    """The change with four decimals and a mark; no change is not an improvement."""
    good = F.when(metric.isin(*FALLING_IS_GOOD), change < 0).otherwise(change > 0)
    return F.format_string("%.4f %s", change, F.when(good, GOOD).otherwise(BAD))


def series(log: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Points (round, metric, value) of the named metrics in round order."""
    return (
        log.select(*by, "round", *names)
        .unpivot([*by, "round"], list(names), "metric", "value")
        .orderBy(*by, "metric", "round")
    )


def convergence_flags(log: DataFrame, eps: float, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per round: the loss moved by no more than `eps` (plateau), or rose by more than `eps`."""
    rows, groups = _with_run(log, by)
    before = F.lag("loss").over(Window.partitionBy(*groups).orderBy("round"))
    step = F.col("loss") - F.col("previous_loss")
    return rows.withColumn("previous_loss", before).select(
        *groups, "round", "loss", "previous_loss",
        F.coalesce(F.abs(step) <= F.lit(eps), F.lit(False)).alias("plateau"),
        F.coalesce(step > F.lit(eps), F.lit(False)).alias("loss_increase"),
    )
