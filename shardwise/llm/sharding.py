"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.llm.store import release, utf8, written

LOW, HIGH = -(2**63), 2**63 - 1
PROBES = 16


def _below(keyed: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows whose key lies below each probe: one pass, one row per probe gap and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(probes, np.int64)
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, batch.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(size[some]), pa.array(rows[some])], ["gap", "size", "rows"])

    found = keyed.select("key", "size").mapInArrow(count, "gap long, size long, rows long").groupBy("gap").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for gap, s, r in found:
        size[gap], rows[gap] = s, r
    return np.cumsum(size).tolist(), np.cumsum(rows).tolist()


def splitters(keyed: DataFrame, parts: int, tolerance: float) -> tuple[list[int], list[int], int]:
    """Keys that cut (key, size) into `parts` ranges of near equal bytes; rows below each; passes taken.

    Each pass counts the bytes below evenly spaced probes inside every open bracket. A splitter is settled once
    its bytes are within `tolerance` of a range's share from its target, or its bracket holds one key.
    """
    sizes, rows = _below(keyed, [])
    total, share = sizes[-1], sizes[-1] / parts
    targets = [share * i for i in range(1, parts)]
    bracket = {i: (LOW, HIGH) for i in range(len(targets))}
    best = dict.fromkeys(bracket, (total, HIGH, rows[-1]))  # distance, key, rows below
    passes = 0
    while bracket:
        probes = sorted({lo + (hi - lo) * k // (PROBES + 1) for lo, hi in bracket.values() for k in range(1, PROBES + 1)} - {LOW})
        if not probes:
            break
        sizes, rows = _below(keyed, probes)
        passes += 1
        sums = np.array(sizes[:-1])
        for i, (lo, hi) in list(bracket.items()):
            # The last probe at or below the target and the first above it close the bracket.
            above = int(np.searchsorted(sums, targets[i], side="right"))
            for at in (above - 1, above):
                if 0 <= at < len(probes):
                    best[i] = min(best[i], (abs(sizes[at] - targets[i]), probes[at], rows[at]))
            lo, hi = max(lo, probes[above - 1]) if above else lo, min(hi, probes[above]) if above < len(probes) else hi
            bracket[i] = (lo, hi)
            if best[i][0] <= tolerance * share or hi - lo <= 1:
                del bracket[i]
    cuts = sorted((key, below) for _, key, below in best.values())
    return [key for key, _ in cuts], [below for _, below in cuts], passes


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, rows_per_range: int = 1_000_000) -> DataFrame:
    """Every column of `docs`, and shard (0 to shards - 1), slot (gapless from 0 in it), shard_size (bytes plus 1).

    The order is that of a hash of id and text, so shards are random samples of the table. Splitters come
    from counting passes over the keys; then rows are exchanged once, into ranges finer than shards where
    shards are large (a multiple of the shard count, from the number of rows), and numbered inside their range
    from the exact count of rows before it. Law: a shard's bytes differ from the mean by twice `tolerance`
    at most, or by one document or one run of identical rows where that is larger.

    Null text counts as no bytes. Null ids, repeated ids and repeated rows are rows like any other. A column
    of `docs` with the name of a new one (shard, slot, shard_size) is replaced; all others stay. Shards may be empty where
    rows are fewer than shards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), (F.octet_length(text).cast("long") + 1).alias("size"), F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"))
    narrow = written(keyed.select("key", "size"), "shard-keys")
    fine = max(1, -(-narrow.count() // (shards * rows_per_range)))
    cuts, below, _ = splitters(narrow, shards * fine, tolerance)
    release(narrow)
    first = np.array([0, *below], np.int64)

    @F.pandas_udf("range int, before long")
    def placed(key: pd.Series) -> pd.DataFrame:
        """The range of a key, and the rows of its shard that lie in ranges before."""
        own = np.searchsorted(np.array(cuts, np.int64), key.to_numpy(), side="right")
        return pd.DataFrame({"range": own.astype(np.int32), "before": first[own] - first[own // fine * fine]})

    ranged = keyed.withColumn("at", placed("key")).select("row", "size", "key", "id", F.col("at.range").alias("range"), F.col("at.before").alias("before"))
    inside = Window.partitionBy("range").orderBy("key", "id", "size")
    out = ranged.withColumn("slot", F.row_number().over(inside) - 1 + F.col("before"))
    new = {"shard": F.floor(F.col("range") / fine).cast("int"), "slot": F.col("slot"), "shard_size": F.col("size")}
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def crc32_of(text: str) -> Column:
    return F.crc32(utf8(F.coalesce(F.col(text), F.lit(""))))
