"""Exact ranks in hash order without sorting a whole group anywhere.

A selection such as "the first 20 % of each client" needs only the key that sits at one rank.
`cutoffs` finds it by counting hash prefixes: each pass reads the key columns, counts rows per
(group, prefix) with map-side combine, and keeps the one prefix that holds the wanted rank.
Applying a cutoff is then a filter, so wide rows are never shuffled and a group of any size is fine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardwise.functions.hashing import hash_order
from shardwise.sources.scratch import DRIVER_ROWS, Settled, local_table, scratch_dir, settle

# Hex digits per counting pass. Two passes leave 1/65536 of a group to sort exactly.
DIGITS = (2, 4)
RANK_DIGITS = 3
# Cutoffs that may be broadcast, and how many share a row of the lookup beyond that.
CUT_BYTES = 8 << 20
CUTS_EACH = 8
# Rows with one prefix (key columns only) that one task may sort.
SORT_ROWS = 2_000_000


def position_key(seed: int, purpose: str, key: list[str]) -> Column:
    """The ordering value: digest first, the key itself breaks (theoretical) ties."""
    return F.struct(hash_order(seed, purpose, *key).alias("h"), *[F.col(k) for k in key])


def _narrow(df: DataFrame, by: list[str], key: list[str], seed: int, purpose: str) -> DataFrame:
    """Only what ranking needs, so the scan below reads nothing else."""
    groups = [F.col(c) for c in by] or [F.lit(0).alias("all_rows")]
    return df.select(*groups, position_key(seed, purpose, key).alias("pos"))


def _prefix(width: int) -> Column:
    return F.substring(F.col("pos.h"), 1, width)


def _histogram(rows: DataFrame, by: list[str], width: int) -> Settled:
    """Rows per (group, prefix) and the rows before each prefix inside its parent prefix."""
    counts = settle(rows.groupBy(*by, "parent", _prefix(width).alias("prefix")).agg(F.count("*").alias("n")), limit=1_000_000)
    order = Window.partitionBy(*by, "parent").orderBy("prefix")
    return Settled(counts.df.withColumn("before", F.sum("n").over(order) - F.col("n")), counts.rows)


def cutoffs(
    df: DataFrame,
    by: list[str],
    key: list[str],
    seed: int,
    purpose: str,
    ranks: Callable[[DataFrame], DataFrame],
    per_group: int = 1,
    digits: tuple[int, ...] = DIGITS,
    sort_rows: int = SORT_ROWS,
) -> Settled:
    """The ordering value at each wanted rank.

    `ranks` turns the group sizes (`by`..., n) into at most `per_group` wanted ranks (`by`..., r)
    each; ranks below 1 select nothing and give no row. Result: `by`..., r, cut. Counting goes one
    level deeper only while a prefix still holds more than `sort_rows` rows or many wanted ranks.
    """
    groups = by or ["all_rows"]
    rows = _narrow(df, by, key, seed, purpose)
    inside, state = rows.withColumn("parent", F.lit("")), None
    for width in digits:
        hist = _histogram(inside, groups, width)
        if state is None:
            wanted = ranks(hist.df.groupBy(*groups).agg(F.sum("n").alias("n"))).where(F.col("r") >= 1)
            state = wanted.select(*groups, "r", F.lit("").alias("parent"), F.col("r").alias("rest"))
        state = (
            state.join(hist.df, [*groups, "parent"])
            .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n")))
            .select(*groups, "r", F.col("prefix").alias("parent"), (F.col("rest") - F.col("before")).alias("rest"))
        )
        # A local histogram bounds the groups, so the wanted ranks may be broadcast unevaluated.
        bounded = hist.rows is not None and hist.rows.num_rows * per_group <= DRIVER_ROWS
        side = F.broadcast(state) if bounded else settle(state).side()
        placed = rows.withColumn("parent", _prefix(width))
        if hist.largest("n") <= sort_rows and per_group <= 16**width:
            break
        inside = placed.join(side.select(*groups, "parent"), [*groups, "parent"], "left_semi")
    # Rows that share a prefix with a wanted rank are numbered once per rank; prefixes are fine
    # enough by now that few ranks share one.
    order = Window.partitionBy(*groups, "parent", "r").orderBy("pos")
    numbered = placed.join(side, [*groups, "parent"]).withColumn("place", F.row_number().over(order))
    return settle(numbered.where(F.col("place") == F.col("rest")).select(*by, "r", F.col("pos").alias("cut")))


def at_or_before(df: DataFrame, by: list[str], key: list[str], seed: int, purpose: str, cut: Settled, flag: str) -> DataFrame:
    """Add a flag: the row is at or before its group's single cutoff. No cutoff means false."""
    if not by:
        return segment(df, key, seed, purpose, cut, flag).withColumn(flag, F.col(flag) == 0)
    joined = df.join(cut.side().select(*by, "cut"), by, "left")
    inside = position_key(seed, purpose, key) <= F.col("cut")
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("cut")


def segment(df: DataFrame, key: list[str], seed: int, purpose: str, cut: Settled, name: str) -> DataFrame:
    """Add how many of the table's cutoffs lie before the row: the 0-based segment it falls in.

    A lookup table with one row per digest prefix holds the cutoffs inside that prefix and the number before it, so each row
    compares itself with its own few cutoffs only. Up to CUT_BYTES of cutoffs the table has 256 rows and is broadcast. With
    more, prefixes get longer, so that each still holds a few, and rows meet their prefix in a shuffled join.
    """
    many = cut.rows is None or cut.rows.nbytes > CUT_BYTES
    lookup, width = _long_lookup(df.sparkSession, cut) if many else (F.broadcast(_prefix_lookup(df.sparkSession, cut)), 2)
    mine = position_key(seed, purpose, key)
    keyed = df.withColumn("segment_pos", mine).withColumn("prefix", F.substring(F.col("segment_pos.h"), 1, width))
    passed = F.size(F.filter("cuts", lambda c: c < F.col("segment_pos")))
    count = F.when(F.size("cuts") == 0, F.lit(0)).otherwise(passed)
    return keyed.join(lookup, "prefix").withColumn(name, (F.col("before") + count).cast("int")).drop("prefix", "segment_pos", "before", "cuts")


def _prefix_lookup(spark: SparkSession, cut: Settled) -> DataFrame:
    """256 rows (prefix, before, cuts)."""
    prefixes = [f"{i:02x}" for i in range(256)]
    inside: dict[str, list] = {p: [] for p in prefixes}
    for value in cut.rows.column("cut").to_pylist():
        inside[value["h"][:2]].append(value)
    sizes = [len(inside[p]) for p in prefixes]
    before = [sum(sizes[:i]) for i in range(256)]
    cuts = pa.array([inside[p] for p in prefixes], pa.list_(cut.rows.schema.field("cut").type))
    return local_table(spark, pa.table({"prefix": prefixes, "before": pa.array(before, pa.int64()), "cuts": cuts})).df


def _long_lookup(spark: SparkSession, cut: Settled) -> tuple[DataFrame, int]:
    """The same for many cutoffs, as a written table, and the length of its prefixes: about CUTS_EACH cutoffs per row.

    A mark for each prefix is numbered among the cutoffs; its place less the marks before it is the number of cutoffs before it.
    """
    total, width = cut.df.count(), 2
    while 16**width * CUTS_EACH < total:
        width += 1
    cuts = cut.df.select(F.substring("cut.h", 1, width).alias("prefix"), F.col("cut.h").alias("h"), F.lit(None).cast("long").alias("mark"))
    marks = spark.range(16**width).select(F.lower(F.lpad(F.hex("id"), width, "0")).alias("prefix"), F.lit("").alias("h"), F.col("id").alias("mark"))
    placed = numbered(cuts.unionByName(marks), [], [("prefix", "ascending"), ("h", "ascending")], "place").df
    before = placed.where("mark is not null").select("prefix", (F.col("place") - F.col("mark")).alias("before"))
    inside = cut.df.groupBy(F.substring("cut.h", 1, width).alias("prefix")).agg(F.collect_list("cut").alias("cuts"))
    every = before.join(inside, "prefix", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast(inside.schema["cuts"].dataType)))
    path = scratch_dir(spark, "cuts")
    every.write.parquet(path)
    return spark.read.schema(every.schema).parquet(path).hint("shuffle_hash"), width


def distributed_rank(df: DataFrame, by: list[str], key: list[str], seed: int, purpose: str, name: str = "rank") -> DataFrame:
    """Add the exact 1-based rank in hash order within each group.

    Rows are numbered inside (group, prefix) and shifted by the rows of the prefixes before, so the
    largest sort is one 4096th of a group.
    """
    prefix = F.substring(hash_order(seed, purpose, *key), 1, RANK_DIGITS)
    keyed = df.withColumn("rank_prefix", prefix)
    before = Window.partitionBy(*by).orderBy("rank_prefix")
    offsets = (
        keyed.groupBy(*by, "rank_prefix")
        .agg(F.count("*").alias("n"))
        .select(*by, "rank_prefix", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    )
    inside = Window.partitionBy(*by, "rank_prefix").orderBy(position_key(seed, purpose, key))
    numbered = keyed.withColumn("rank_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*by, "rank_prefix"])
        .withColumn(name, F.col("rank_inside") + F.col("offset"))
        .drop("rank_prefix", "rank_inside", "offset")
    )


def numbered(df: DataFrame, by: list[str], order: list[tuple[str, str]], name: str, limit: int = DRIVER_ROWS) -> Settled:
    """Add the 0-based place (long) of each row within its `by` group, in the given order of (column, "ascending" or "descending").

    A small table is numbered where it is. Beyond `limit` rows, ranges of the order are numbered by the task that holds them
    and shifted by the rows of the ranges before: no task sees a whole group, and only a count per range reaches the driver.
    Columns ordered downwards must not hold nulls; upwards, nulls come first.
    """
    held = settle(df, limit)
    keys = [*[(c, "ascending") for c in by], *order]
    if held.rows is not None:
        rows = held.rows.take(pc.sort_indices(held.rows, sort_keys=keys, null_placement="at_start"))
        places, last, at = [], None, 0
        for key in zip(*(rows.column(c).to_pylist() for c in by), strict=True) if by else [()] * rows.num_rows:
            at = at + 1 if key == last else 0
            last = key
            places.append(at)
        return local_table(df.sparkSession, rows.append_column(name, pa.array(places, pa.int64())))
    spark, columns = df.sparkSession, df.columns
    sort = [F.col(c).asc() if way == "ascending" else F.col(c).desc() for c, way in keys]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for key in zip(*(batch.column(columns.index(c)).to_pylist() for c in by), strict=True) if by else [()] * batch.num_rows:
                at = at + 1 if key == last else 0
                last = key
                places.append(at)
            arrays = [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "numbered_part", name])

    schema = StructType(list(held.df.schema.fields)).add("numbered_part", "integer").add(name, "long")
    path = scratch_dir(spark, "numbered")
    held.df.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(count, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    sizes = rows.groupBy(*by, "numbered_part").agg(F.count("*").alias("n")).collect()  # ranges + groups rows at most
    shifts, before = [], {}
    for r in sorted(sizes, key=lambda r: r["numbered_part"]):
        key = tuple(r[c] for c in by)
        shifts.append((*key, r["numbered_part"], before.get(key, 0)))
        before[key] = before.get(key, 0) + r["n"]
    kinds = [rows.schema[c] for c in [*by, "numbered_part"]]
    shift = spark.createDataFrame(shifts, StructType(kinds).add("shift", "long"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "numbered_part"]]
    joined = rows.alias("a").join(F.broadcast(shift).alias("b"), reduce(Column.__and__, same))
    return Settled(joined.select(*[F.col(f"a.{c}") for c in columns], (F.col(f"a.{name}") + F.col("b.shift")).alias(name)), None)
