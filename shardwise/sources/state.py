"""Scalers, linear parameters and forests as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

_ARRAY = ArrayType(DoubleType())
SCALER_SCHEMA = StructType().add("feature", "string").add("mean", "double").add("scale", "double").add("n", "long")
PARAMS_SCHEMA = (
    StructType().add("round", "integer").add("client_id", "integer").add("n_examples", "long")
    .add("status", "string").add("coef", _ARRAY).add("intercept", "double")
)
NODES_SCHEMA = (
    StructType().add("round", "integer").add("client_id", "integer").add("tree_id", "integer").add("node_id", "integer")
    .add("feature", "integer").add("threshold", "double").add("left", "integer").add("right", "integer")
    .add("counts", _ARRAY).add("gain", "double").add("n", "long")
)


def save_scaler(scaler: DataFrame, path: str) -> None:
    """Store scaler state for later runs."""
    scaler.select(*SCALER_SCHEMA.names).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    """Scaler state of an earlier run."""
    return spark.read.schema(SCALER_SCHEMA).parquet(path)


def _write_round(df: DataFrame, path: str, round_no: int, schema: StructType) -> None:
    columns = [c for c in schema.names if c != "round"]
    rows = df.select(*columns, F.lit(round_no).cast("int").alias("round"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def _read_rounds(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_params(params: DataFrame, path: str, round_no: int) -> None:
    """Checkpoint the parameters of one round; a repeated round replaces itself only."""
    _write_round(params, path, round_no, PARAMS_SCHEMA)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """All checkpointed parameters."""
    return _read_rounds(spark, path, PARAMS_SCHEMA)


def latest(params: DataFrame) -> DataFrame:
    """Rows of the last round; a one-row maximum is the only thing joined."""
    last = params.agg(F.max("round").alias("round"))
    return params.join(F.broadcast(last), "round", "left_semi").select(*params.columns)


def latest_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of the last checkpointed round."""
    return latest(read_params(spark, path))


def write_forest(nodes: DataFrame, path: str, round_no: int) -> None:
    """Checkpoint the forest of one round."""
    _write_round(nodes, path, round_no, NODES_SCHEMA)


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """All checkpointed forests."""
    return _read_rounds(spark, path, NODES_SCHEMA)


def params_row(df: DataFrame, coef: list[Column], intercept: Column | None = None) -> DataFrame:
    """Rows of a parameter table from weight columns; no intercept is stored as null."""
    bias = F.lit(None).cast("double") if intercept is None else intercept.cast("double")
    return df.select(
        *[F.col(c).cast(PARAMS_SCHEMA[c].dataType).alias(c) if c in df.columns else F.lit(None).cast(PARAMS_SCHEMA[c].dataType).alias(c)
          for c in ("round", "client_id", "n_examples", "status")],
        F.array(*[c.cast("double") for c in coef]).alias("coef"),
        bias.alias("intercept"),
    )


def with_params(df: DataFrame, params: DataFrame, on: list[str]) -> DataFrame:
    """Attach model parameters to rows by client, round or both."""
    return df.join(params.select(*on, "coef", "intercept"), on)
