"""Random forests of all clients at once, level by level, from histograms.

One pass over the rows per depth: tasks walk every row down the trees of its client so far and count labels by
(client, tree, node, feature, bin), with the bootstrap weight of the row in that tree. Only those counts are shuffled. The
best split of each node is chosen from them, and the next pass goes one level deeper.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardwise.functions.hashing import hash_order, uniform
from shardwise.sources.scratch import DRIVER_ROWS, local_table, scratch_dir, settle
from shardwise.sources.state import NODES_SCHEMA

# Bins of a feature at most, and rows of a client that place them (about; every row is counted).
BINS = 32
SAMPLE_ROWS = 2048
# Bins and trees that travel with the tasks of one pass; the clients beyond are fitted after these.
CHUNK_BYTES = 32 << 20
# Histogram cells a task holds before it passes them on.
CELLS = 4_000_000
# A split must lower the impurity by more than rounding does.
LEAST_GAIN = 1e-12
_TREES_PER_DIGEST = 8


def poisson_bounds() -> list[int]:
    """Bounds on a 16-bit number: a row is drawn as often as bounds are not above it. Poisson with mean 1."""
    bounds, term, total = [], math.exp(-1), 0.0
    while not bounds or bounds[-1] < 65_535:
        total += term
        bounds.append(int(65_536 * total))
        term /= len(bounds)
    return bounds


def plan_table(spark: SparkSession, clients: Sequence[int], first: int, trees: int) -> DataFrame:
    """A fitting plan (client_id, first, trees): the same new trees for each client."""
    n = len(clients)
    rows = pa.table({"client_id": pa.array(clients, pa.int32()), "first": pa.array([first] * n, pa.int32()), "trees": pa.array([trees] * n, pa.int32())})
    return local_table(spark, rows).df


def candidate_bins(train: DataFrame, key: list[str], seed: int, bins: int = BINS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """client_id, cuts: for each feature the values between bins, at equal ranks of about `sample_rows` rows of the client."""
    counts = settle(train.groupBy("client_id").agg(F.count("*").alias("rows")))
    some = train.join(counts.side(), "client_id").where(uniform(hash_order(seed, "bins", *key)) * F.col("rows") <= float(sample_rows))
    values = some.select("client_id", F.posexplode("x").alias("feature", "v")).groupBy("client_id", "feature").agg(F.sort_array(F.collect_list("v")).alias("v"))
    at = lambda j: F.get(F.col("v"), F.floor((j * F.size("v") + (bins - 1)) / bins).cast("int") - 1)
    cuts = values.select("client_id", "feature", F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), at)).alias("cuts"))
    return cuts.groupBy("client_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "cuts"))), lambda s: s["cuts"]).alias("cuts"))


@dataclass
class _Grown:
    """The trees of one client: bins per feature, tree ids, and a heap of nodes per tree (children of i: 2i+1, 2i+2)."""

    cuts: list[np.ndarray]
    ids: list[int]
    feature: np.ndarray
    threshold: np.ndarray
    gain: np.ndarray
    counts: np.ndarray
    open: list[tuple[int, int]] = field(default_factory=list)
    subsets: np.ndarray | None = None


def _ranked_features(seed: int, round_no: int, client: int, tree: int, node: int, width: int, some: int) -> list[int]:
    """The features a node may split on: the first of a seeded order."""
    digest = lambda f: hashlib.md5(f"{seed}|features|{round_no}|{client}|{tree}|{node}|{f}".encode()).hexdigest()
    return sorted(range(width), key=digest)[:some]


def _impurity(zero: Column, one: Column) -> Column:
    n = zero + one
    return F.lit(1.0) - (zero / n) * (zero / n) - (one / n) * (one / n)


def best_splits(cells: DataFrame) -> DataFrame:
    """Counts (client_id, tree, node, feature, bin, n0, n1) to a row per node: t0, t1 and best (feature, bin, l0, l1, gain).

    Rows of bins up to `bin` go left. Of equal gains the first feature, then the first bin; `best` is null where nothing splits.
    """
    node = ["client_id", "tree", "node"]
    whole = Window.partitionBy(*node, "feature")
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.select(*node, "feature", "bin", *[F.sum(f"n{k}").over(so_far).cast("double").alias(f"l{k}") for k in (0, 1)], *[F.sum(f"n{k}").over(whole).cast("double").alias(f"t{k}") for k in (0, 1)])
    l0, l1, t0, t1 = (F.col(c) for c in ("l0", "l1", "t0", "t1"))
    left, total = l0 + l1, t0 + t1
    gain = _impurity(t0, t1) - left / total * _impurity(l0, l1) - (total - left) / total * _impurity(t0 - l0, t1 - l1)
    rows = rows.withColumn("gain", F.when((left > 0) & (left < total), gain))
    ordering = F.when(F.col("gain") > LEAST_GAIN, F.struct("gain", -F.col("feature"), -F.col("bin")))
    best = F.max_by(F.struct("feature", "bin", "l0", "l1", "gain"), ordering).alias("best")
    return rows.groupBy(*node).agg(F.max("t0").alias("t0"), F.max("t1").alias("t1"), best, F.max(ordering.isNotNull()).alias("splits"))


def _histograms(train: DataFrame, grown: dict[int, _Grown], blocks: list[int], nodes: int, bins: int) -> DataFrame:
    """Label counts of all open nodes of the given clients, summed over the rows."""
    bounds = np.array(poisson_bounds())
    place = {b: i for i, b in enumerate(blocks)}
    state = {}
    for client, g in grown.items():
        if g.open:
            slots = np.full((len(g.ids), nodes), -1, np.int64)
            for s, (t, node) in enumerate(g.open):
                slots[t, node] = s
            at = [place[i // _TREES_PER_DIGEST] * _TREES_PER_DIGEST + i % _TREES_PER_DIGEST for i in g.ids]
            state[client] = (g.cuts, np.array(at), g.feature, g.threshold, slots, g.subsets, [(g.ids[t], node) for t, node in g.open])
    cells = CELLS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for client, hist in held.items():
                subsets, names = state[client][5:]
                j, s, b = np.nonzero(hist.sum(axis=3))
                tree, node = (np.array([n[i] for n in names])[s] for i in (0, 1))
                columns = [np.full(len(j), client), tree, node, subsets[s, j], b, hist[j, s, b, 0], hist[j, s, b, 1]]
                kinds = [pa.int32()] * 5 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], ["client_id", "tree", "node", "feature", "bin", "n0", "n1"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            clients, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            x = batch.column(2).flatten().to_numpy().reshape(len(y), -1)
            drawn = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u2").reshape(len(y), -1)
            for client in np.unique(clients).tolist():
                if client not in state:
                    continue
                cuts, at, feature, threshold, slots, subsets, names = state[client]
                mine = np.flatnonzero(clients == client)
                own, row = x[mine], np.arange(len(mine))[:, None]
                weight = np.searchsorted(bounds, drawn[mine][:, at], side="right")
                tree, node = np.arange(len(at)), np.zeros((len(mine), len(at)), np.int64)
                while True:
                    split = feature[tree, node]
                    below = np.where(own[row, np.maximum(split, 0)] <= threshold[tree, node], 2 * node + 1, 2 * node + 2)
                    moved = np.where(split < 0, node, below)
                    if (moved == node).all():
                        break
                    node = moved
                slot = np.where(node < slots.shape[1], slots[tree, np.minimum(node, slots.shape[1] - 1)], -1)
                hit = (slot >= 0) & (weight > 0)
                r, w, s = np.nonzero(hit)[0], weight[hit].astype(float), slot[hit]
                binned = np.zeros(own.shape, np.int64)
                for f in np.unique(subsets).tolist():
                    binned[:, f] = np.searchsorted(cuts[f], own[:, f], side="left")
                hist = held.setdefault(client, np.zeros((subsets.shape[1], len(names), bins, 2), np.int64))
                for j in range(subsets.shape[1]):
                    index = (s * bins + binned[r, subsets[s, j]]) * 2 + y[mine][r]
                    hist[j] += np.bincount(index, weights=w, minlength=hist[j].size).astype(np.int64).reshape(hist[j].shape)
            if sum(h.size for h in held.values()) > cells:
                yield from passed_on()
        yield from passed_on()

    schema = "client_id int, tree int, node int, feature int, bin int, n0 long, n1 long"
    counted = train.mapInArrow(count, schema)
    return counted.groupBy("client_id", "tree", "node", "feature", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _settle_split(g: _Grown, tree: int, node: int, counts: tuple[float, float], best: dict | None, depth: int) -> list[tuple[int, int]]:
    """Store a node's counts and its split; the children that may split in turn."""
    t = g.ids.index(tree)
    g.counts[t, node] = counts
    if best is None:
        return []
    feature, cut = best["feature"], best["bin"]
    g.feature[t, node], g.threshold[t, node], g.gain[t, node] = feature, g.cuts[feature][cut], best["gain"]
    left = (best["l0"], best["l1"])
    further = []
    for child, (zero, one) in ((2 * node + 1, left), (2 * node + 2, (counts[0] - left[0], counts[1] - left[1]))):
        g.counts[t, child] = zero, one
        if zero > 0 and one > 0 and child + 1 < 1 << depth:
            further.append((t, child))
    return further


def _node_rows(grown: dict[int, _Grown], round_no: int | None) -> pa.Table:
    columns: dict[str, list] = {f.name: [] for f in NODES_SCHEMA.fields}
    for client, g in sorted(grown.items()):
        for t, tree in enumerate(g.ids):
            stack = [0]
            while stack:
                node = stack.pop()
                leaf = g.feature[t, node] < 0
                row = (round_no, client, tree, node, int(g.feature[t, node]), None if leaf else float(g.threshold[t, node]), -1 if leaf else 2 * node + 1, -1 if leaf else 2 * node + 2, g.counts[t, node].tolist(), float(g.gain[t, node]), int(g.counts[t, node].sum()))
                for name, value in zip(columns, row, strict=True):
                    columns[name].append(value)
                if not leaf:
                    stack += [2 * node + 2, 2 * node + 1]
    kinds = {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array": pa.list_(pa.float64())}
    return pa.table({f.name: pa.array(columns[f.name], kinds[f.dataType.typeName()]) for f in NODES_SCHEMA.fields})


def _chunks(plan: DataFrame, per_client: int, per_tree: int, limit: int) -> Iterator[list[tuple[int, int, int]]]:
    """Clients in order, as many at a time as the limit allows; the plan itself is read bit by bit."""
    held, size = [], 0
    for client, first, trees in plan.select("client_id", "first", "trees").where("trees > 0").orderBy("client_id").toLocalIterator():
        own = per_client + trees * per_tree
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append((client, first, trees))
        size += own
    if held:
        yield held


def fit_trees(
    train: DataFrame, plan: DataFrame, depth: int, seed: int, round_no: int | None = None, key: str | list[str] = "key",
    some: int | None = None, bins: int = BINS, sample_rows: int = SAMPLE_ROWS, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """New trees for every client of the plan (client_id, first, trees), as a node table; tree ids count up from `first`.

    `train` has client_id, key, label (0 or 1) and x. A row takes part in a tree as often as a Poisson draw says, which is a hash
    of its key, the round and the tree id; a node looks at `some` features (the root of their number), also drawn by hash. So
    the trees do not depend on partitions, retries or the other clients. Splits lie between `bins` bins of equal ranks per client and
    feature and go by Gini impurity; nodes end at `depth`, when they are pure, or when nothing splits them.

    Each depth is one job over all clients of a chunk, and a chunk holds as many clients as `chunk_bytes` of bins and
    trees allow. A client without rows, or a tree that draws none, has a single leaf without counts.
    """
    spark, key = train.sparkSession, [key] if isinstance(key, str) else list(key)
    number = round_no or 0
    head = train.select(F.size("x").alias("width")).first()
    width = head["width"] if head else 1
    some = some or max(1, math.isqrt(width))
    cuts = settle(candidate_bins(train, key, seed, bins, sample_rows), limit=DRIVER_ROWS // (width * bins) + 1).df
    size = (1 << (depth + 1)) - 1
    parts, path = [], None
    for chunk in _chunks(plan, width * bins * 8, size * 24, chunk_bytes):
        low, high = chunk[0][0], chunk[-1][0]
        inside = F.col("client_id").between(low, high)
        known = {r["client_id"]: [np.array(c) for c in r["cuts"]] for r in cuts.where(inside).collect()}
        grown = {}
        for client, first, trees in chunk:
            shape = (trees, size)
            g = _Grown(known.get(client, []), list(range(first, first + trees)), np.full(shape, -1), np.zeros(shape), np.full(shape, -1.0), np.zeros((*shape, 2)))
            g.open = [(t, 0) for t in range(trees)] if client in known and depth > 0 else []
            grown[client] = g
        blocks = sorted({i // _TREES_PER_DIGEST for g in grown.values() for i in g.ids})
        drawn = F.concat(*[F.unhex(hash_order(seed, "bag", F.lit(number), F.lit(b), *key)) for b in blocks])
        rows = train.where(inside).select("client_id", F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x"), drawn.alias("drawn"))
        for _ in range(depth):
            for client, g in grown.items():
                features = [_ranked_features(seed, number, client, g.ids[t], node, width, some) for t, node in g.open]
                g.subsets = np.array(features, np.int64).reshape(len(g.open), min(some, width))
            if not any(g.open for g in grown.values()):
                break
            found = best_splits(_histograms(rows, grown, blocks, size, bins)).collect()  # a row per open node of the chunk
            for g in grown.values():
                g.open = []
            for r in found:
                g = grown[r["client_id"]]
                g.open += _settle_split(g, r["tree"], r["node"], (r["t0"], r["t1"]), r["best"].asDict() if r["splits"] else None, depth)
        made = local_table(spark, _node_rows(grown, round_no), NODES_SCHEMA).df
        if parts or path:  # several chunks are kept as a table, not on the driver
            path = path or scratch_dir(spark, "fitted")
            for part in [*parts, made]:
                part.write.mode("append").parquet(path)
            parts = []
        else:
            parts = [made]
    if path:
        return spark.read.schema(NODES_SCHEMA).parquet(path)
    return parts[0] if parts else spark.createDataFrame([], NODES_SCHEMA)
