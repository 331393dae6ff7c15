"""Shared scratch space and one-time evaluation of small tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DRIVER_ROWS = 200_000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder the cluster names; a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


@dataclass(frozen=True)
class Settled:
    """A table evaluated once: `df` never repeats the work behind it.

    `rows` holds the same table on the driver when it was small enough, else None.
    """

    df: DataFrame
    rows: pa.Table | None

    @property
    def small(self) -> bool:
        return self.rows is not None

    def side(self) -> DataFrame:
        """The join side: broadcast only when its row count was checked."""
        return F.broadcast(self.df) if self.small else self.df

    def largest(self, column: str) -> int:
        """Greatest value of a count column, 0 for an empty table."""
        if self.rows is not None:
            return pc.max(self.rows.column(column)).as_py() or 0
        return self.df.agg(F.max(column)).first()[0] or 0

    def only(self, column: str, values: list) -> Settled:
        """The rows with one of the given values."""
        if self.rows is None:
            return Settled(self.df.where(F.col(column).isin(values)), None)
        kept = self.rows.filter(pc.is_in(self.rows[column], pa.array(values, self.rows.schema.field(column).type)))
        return local_table(self.df.sparkSession, kept, self.df.schema)

    def records(self) -> list[dict]:
        """The rows as dictionaries; only for tables that were checked to be small."""
        if self.rows is None:
            raise ValueError("table too large for the driver")
        return self.rows.to_pylist()


def local_table(spark: SparkSession, rows: pa.Table, schema: StructType | None = None) -> Settled:
    """A small table that is already on the driver."""
    made = spark.createDataFrame(rows, schema=schema) if schema is not None else spark.createDataFrame(rows)
    return Settled(made.coalesce(1), rows)


def settle(df: DataFrame, limit: int = DRIVER_ROWS) -> Settled:
    """Evaluate a table of counts, cut points or parameters once and cut its lineage.

    Up to `limit` rows become a local relation in one partition: the optimizer knows its exact size
    and further steps on it need no shuffle. A larger result goes to the shared scratch folder and
    is joined by shuffle.
    """
    spark = df.sparkSession
    head = df.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        return local_table(spark, head, df.schema)
    path = scratch_dir(spark, "settled")
    df.write.parquet(path)
    return Settled(spark.read.schema(df.schema).parquet(path), None)
