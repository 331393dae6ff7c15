"""From a labelled CSV to train and test CSV files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from shardwise.operators.sampling import random_split
from shardwise.sources.observations import INDEX, read_observations, write_split


def prepare(spark: SparkSession, source: str, target: str, key: str = INDEX, test_fraction: float = 0.2, seed: int = 42, fmt: str = "csv", schema: StructType | str | None = None) -> None:
    """Read, split at random with an exact test size, write both parts."""
    rows = read_observations(spark, source, fmt, schema)
    write_split(random_split(rows, [key], test_fraction, seed), target)
