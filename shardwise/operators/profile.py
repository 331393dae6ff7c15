"""Class balance and shape of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.config import IMBALANCE


def class_balance(df: DataFrame, by: list[str], label: str, threshold: float = IMBALANCE) -> DataFrame:
    """Counts and shares per class, total and imbalance flag of each group.

    Rows are counted per (group, label) first, so only label counts meet in a group.
    """
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(label), F.col("n"))))
    grouped = counts.groupBy(*by).agg(
        F.map_from_entries(entries).alias("distribution"),
        F.sum("n").alias("total_samples"),
        F.max("n").alias("largest"),
    )
    return grouped.select(
        *by,
        "distribution",
        F.transform_values("distribution", lambda _, n: n / F.col("total_samples")).alias("proportions"),
        (F.col("largest") / F.col("total_samples") > F.lit(threshold)).alias("is_imbalanced"),
        "total_samples",
    )


def dataset_profile(df: DataFrame, by: list[str], label: str, features: list[str], threshold: float = IMBALANCE) -> DataFrame:
    """Class balance plus the feature count (0 for an empty set)."""
    width = F.when(F.col("total_samples") > 0, F.lit(len(features))).otherwise(F.lit(0))
    return class_balance(df, by, label, threshold).withColumn("num_features", width)


def partition_shape(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows and features of each client."""
    return df.groupBy("client_id").agg(F.count("*").alias("rows")).withColumn("features", F.lit(len(features)))


def positive_ratio(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Share of positive rows per group."""
    return df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("positive_ratio"))


def prediction_distribution(scored: DataFrame, by: list[str]) -> DataFrame:
    """Actual and predicted rows of each class."""
    return scored.groupBy(*by).agg(
        F.count_if(F.col("label") == 0).alias("actual_negative"),
        F.count_if(F.col("label") == 1).alias("actual_positive"),
        F.count_if(F.col("pred") == 0).alias("predicted_negative"),
        F.count_if(F.col("pred") == 1).alias("predicted_positive"),
    )


def weight_stats(params: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of the weights."""
    return (
        params.select(*by, F.explode("coef").alias("w"))
        .groupBy(*by)
        .agg(F.avg("w").alias("weight_mean"), F.stddev_pop("w").alias("weight_std"))
    )
