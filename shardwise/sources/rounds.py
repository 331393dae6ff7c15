"""The round log and the summary table on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardwise.config import LOG_METRICS

# The log holds one row per round with these columns.
ROUND_COLUMNS = ("round", *LOG_METRICS)


def write_round_log(log: DataFrame, path: str) -> None:
    """Write the whole history as JSON and as CSV, in round order. One row per round by construction."""
    ordered = log.orderBy("round").coalesce(1)
    ordered.write.mode("overwrite").json(f"{path}/json")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_round_log(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a round log: any repeated round column dropped, all columns numeric, sorted by round.

    Metrics that the log does not have (a forest's has loss and accuracy only) are null.
    JSON may be one record per round or the older single object keyed by round.
    """
    if fmt == "json":
        raw = _read_json(spark, path)
    else:
        raw = _read_csv(spark, path)
    extra = [c for c in raw.columns if c not in ROUND_COLUMNS]
    numbers = [(F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(c) for c in (*LOG_METRICS, *extra)]
    return raw.select(F.col("round").try_cast("int").alias("round"), *numbers).orderBy("round")


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.text(path).limit(1).collect()[0][0]
    names = header.strip().split(",")
    positions = [f"c{i}" for i in range(len(names))]
    raw = spark.read.schema(StructType.fromDDL(", ".join(f"{p} STRING" for p in positions))).option("header", True).csv(path)
    # The last column of a name wins, so a leading row-name copy of the round is dropped by position.
    keep = {name.split(".")[0] if name.startswith("round.") else name: p for name, p in zip(names, positions)}
    return raw.select(*[F.col(p).alias(name) for name, p in keep.items()])


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    record = ", ".join(f"{c} STRING" for c in ROUND_COLUMNS)
    text = spark.read.text(path, wholetext=True)
    keyed = text.select(F.from_json("value", f"map<string, struct<{record}>>").alias("m"))
    rows = keyed.where(F.exists(F.map_values("m"), lambda v: v["round"].isNotNull()))
    if rows.limit(1).count() == 1:
        return rows.select(F.explode(F.map_values("m")).alias("r")).select("r.*")
    return spark.read.schema(StructType.fromDDL(record)).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Write the summary table as CSV with a header."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
