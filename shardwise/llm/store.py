"""Tables written to the shared folder, and what several operators do with documents."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.sources.scratch import scratch_dir

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The table, evaluated once and read back from the shared folder: its lineage ends there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def release(table: DataFrame) -> None:
    """Remove the folder of a written() table once all that is read from it is itself written."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(table))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids as long and texts without nulls, under fixed names and without any other column."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(text: str | Column) -> Column:
    return F.encode(text, "UTF-8")


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers stay, idle, while other stages run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, with give_back() when a task is through."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def sorted_groups(df: DataFrame, keys: list[str], task: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply `task` to the rows of each key, one group in memory at a time.

    Many small groups cost far less this way than one call through Spark for each. Groups must be
    bounded by the caller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            marks = list(zip(*columns, strict=True))
            begin = 0
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[begin]:
                    if held and marks[begin] != key:
                        yield from task(key, pa.Table.from_batches(held))
                        held = []
                    key = marks[begin]
                    held.append(batch.slice(begin, i - begin))
                    begin = i
        if held:
            yield from task(key, pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(giving_back(run), schema)
