"""Reading, checking and preparing labelled observation tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from shardwise.sources.scratch import complete

# The columns that are not features.
LABEL = "label"
INDEX = "Unnamed: 0"


def read_observations(spark: SparkSession, source: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """Read a labelled table: `csv` with a header, any other file format by name, or `table`.

    Give a schema for large CSV input; inferring one costs a second scan.
    """
    if fmt == "table":
        return spark.table(source)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return reader.load(source)


def feature_columns(df: DataFrame, label: str = LABEL, key: str = INDEX) -> list[str]:
    """Every column but the label and the row index."""
    return [c for c in df.columns if c not in (label, key)]


def assemble(df: DataFrame, features: list[str], dtype: str = "double", name: str = "x") -> DataFrame:
    """Add one array column with the features; `float` rounds values to single precision."""
    cast = [F.col(c).cast(dtype).cast("double") for c in features]
    return df.withColumn(name, F.array(*cast))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with no null (or NaN) in the given columns."""
    return df.dropna(subset=columns)


def labelled_vectors(
    df: DataFrame, features: list[str], key: str, label: str = LABEL, dtype: str = "double", on_incomplete: str = "fail"
) -> DataFrame:
    """(key, label, x). The features travel as one array from here on: many separate columns make
    plans and generated code slow.

    A row without key or label, or with a feature that is null, NaN or infinite, is incomplete: "fail"
    ends the job at the first one, "drop" leaves them out (`incomplete_vectors` counts them).
    """
    rows = _vectors(df, features, key, label, dtype)
    if on_incomplete == "drop":
        return rows.where(_whole(key))
    if on_incomplete == "fail":
        stop = F.raise_error(F.lit("incomplete row: no key, no label or a feature that is no finite number; on_incomplete='drop' leaves such rows out"))
        return rows.where(F.when(_whole(key), True).otherwise(stop))
    raise ValueError(f"unknown on_incomplete: {on_incomplete}")


def incomplete_vectors(df: DataFrame, features: list[str], key: str, label: str = LABEL, dtype: str = "double") -> DataFrame:
    """Rows in total and rows that `labelled_vectors` drops."""
    rows = _vectors(df, features, key, label, dtype)
    return rows.agg(F.count("*").alias("rows"), F.count_if(~_whole(key)).alias("incomplete"))


def _vectors(df: DataFrame, features: list[str], key: str, label: str, dtype: str) -> DataFrame:
    return assemble(df, features, dtype).select(F.col(key), F.col(label).cast("int").alias(LABEL), "x")


def _whole(key: str) -> Column:
    broken = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(key).isNotNull() & F.col(LABEL).isNotNull() & ~broken


def incomplete_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in total and rows `complete_rows` would drop."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(broken).alias("incomplete"))


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write train and test rows as CSV with a header, one folder per split."""
    df.write.mode(mode).partitionBy("split").option("header", True).csv(path)


def prepared_key(**parts) -> str:
    """Name of a prepared table: a digest of everything that shaped it."""
    text = "|".join(f"{k}={parts[k]}" for k in sorted(parts))
    return hashlib.md5(text.encode()).hexdigest()


def _prepared_path(cache_dir: str, parts: dict) -> str:
    return f"{cache_dir.rstrip('/')}/prepared-{prepared_key(**parts)}"


def prepared_before(spark: SparkSession, cache_dir: str, **parts) -> DataFrame | None:
    """The prepared table of an earlier run with the same parts, if its write was finished."""
    path = _prepared_path(cache_dir, parts)
    return spark.read.parquet(path) if complete(spark, path) else None


def prepared(df: DataFrame, cache_dir: str, **parts) -> DataFrame:
    """Write the prepared rows once, partitioned by client; later calls with the same parts read them."""
    spark = df.sparkSession
    path = _prepared_path(cache_dir, parts)
    if not complete(spark, path):
        # Rebalancing by client gives each client few, even files and splits a very large client.
        even = df.hint("rebalance", F.col("client_id"))
        even.write.mode("overwrite").partitionBy("client_id").parquet(path)
    fields = [f for f in df.schema.fields if f.name != "client_id"] + [df.schema["client_id"]]
    return spark.read.schema(StructType(fields)).parquet(path)
