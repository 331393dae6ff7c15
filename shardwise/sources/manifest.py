"""Which rounds of a run are finished, so that a run that was cut off goes on after the last one.

A round's tables are written first, each replacing only what an earlier try at that round left, and the round is committed
last. Whatever lies beyond the last committed round is written anew.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardwise.sources.scratch import complete

_SCHEMA = StructType().add("run_key", "string").add("round", "integer")


def run_key(cfg: object, **parts) -> str:
    """Everything that shapes a round's result; how many rounds there are and the hooks are left out."""
    named = {f.name: getattr(cfg, f.name) for f in fields(cfg) if f.compare and f.name != "rounds"} | parts
    return "|".join(f"{k}={named[k]}" for k in sorted(named))


def begin_run(spark: SparkSession, out_dir: str, key: str) -> None:
    """Start over: no round counts as finished."""
    spark.createDataFrame([(key, 0)], _SCHEMA).coalesce(1).write.mode("overwrite").partitionBy("round").parquet(f"{out_dir}/committed")


def committed_round(spark: SparkSession, out_dir: str, key: str) -> int:
    """The last finished round, 0 where none is; the folder must not belong to another run."""
    path = f"{out_dir}/committed"
    if not complete(spark, path):
        begin_run(spark, out_dir, key)
        return 0
    found = spark.read.schema(_SCHEMA).parquet(path).agg(F.max("round").alias("last"), F.bool_and(F.col("run_key") == key).alias("own")).first()
    if not found["own"]:
        raise ValueError(f"{out_dir} holds rounds of a run with other settings")
    return found["last"]


def commit_round(spark: SparkSession, out_dir: str, key: str, round_no: int) -> None:
    """Mark a round as finished; doing it twice changes nothing."""
    row = spark.createDataFrame([(key, round_no)], _SCHEMA).coalesce(1)
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(f"{out_dir}/committed")


def write_round(df: DataFrame, path: str, round_no: int) -> None:
    """A small table of one round below `path`; a repeated round replaces itself only."""
    rows = df.withColumn("round", F.lit(round_no).cast("int")).coalesce(1)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def read_rounds(spark: SparkSession, path: str, schema: StructType, last: int) -> DataFrame:
    """The rows of the rounds up to `last`."""
    return spark.read.schema(schema).parquet(path).where(F.col("round") <= last).select(*schema.names)
