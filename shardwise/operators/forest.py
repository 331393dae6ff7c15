"""Random forests as node tables: training, merging, scoring, pruning and importances.

A forest is rows (tree_id, node_id, feature, threshold, left, right, counts, gain, n); a leaf has left = -1. Training
(forest_fit) makes such rows, a forest from MLlib can be read as such, and everything else works on that table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shardwise.functions.hashing import hash_order, normal, uniform
from shardwise.operators.forest_fit import fit_trees, plan_table
from shardwise.operators.ranking import numbered
from shardwise.sources.scratch import Settled, settle
from shardwise.sources.state import NODES_SCHEMA

# Nodes sent to every task in one scoring pass; a larger set of trees is scored in several passes.
PASS_NODES = 200_000
# Leaf masks and the arrays made with them in a task.
MASK_BYTES = 64 << 20
# Up to this many trees a forest is written out as column expressions.
EXPRESSION_TREES = 10
EXPRESSION_NODES = 400


def forest_to_nodes(model: RandomForestClassificationModel, path: str, client: int | None = None, round_no: int | None = None) -> DataFrame:
    """Take over a forest that MLlib trained: save it below `path` and read its trees back as a node table."""
    model.save(path)
    node = F.col("nodeData")
    saved = SparkSession.active().read.parquet(f"{path}/data")
    return saved.select(
        F.lit(round_no).cast("int").alias("round"),
        F.lit(client).cast("int").alias("client_id"),
        F.col("treeID").alias("tree_id"),
        node["id"].alias("node_id"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["impurityStats"].alias("counts"),
        node["gain"].alias("gain"),
        node["rawCount"].alias("n"),
    )


def fit_forest(df: DataFrame, trees: int, depth: int, seed: int, client: int | None = None, round_no: int | None = None, key: str = "key") -> DataFrame:
    """Train one forest on all rows of `df` (key, label, x) and return its nodes."""
    rows = df.withColumn("client_id", F.lit(client or 0))
    fitted = fit_trees(rows, plan_table(df.sparkSession, [client or 0], 0, trees), depth, seed, round_no, key)
    return fitted if client is not None else fitted.withColumn("client_id", F.lit(None).cast("int")).select(*NODES_SCHEMA.names)


def fit_forests(train: DataFrame, clients: Sequence[int], trees: int, depth: int, seed: int, round_no: int | None = None, key: str = "key") -> DataFrame:
    """One forest per client on its rows (client_id, key, label, x): one job per depth for all of them."""
    return fit_trees(train, plan_table(train.sparkSession, clients, 0, trees), depth, seed, round_no, key)


def initial_forest(spark: SparkSession, width: int, trees: int, depth: int, seed: int) -> DataFrame:
    """The starting forest, fitted on 100 rows of noise that hashes give."""
    values = F.array(*[normal(hash_order(seed, "noise", F.lit(i), "key")) for i in range(width)])
    label = (uniform(hash_order(seed, "noise label", "key")) <= 0.5).cast("int")
    noise = settle(spark.range(100).select(F.col("id").alias("key")).select("key", label.alias("label"), values.alias("x"))).df
    return fit_forest(noise, trees, depth, seed, round_no=0)


def tree_ledger(nodes: DataFrame) -> DataFrame:
    """How many trees each client has and the id of its next one: (client_id, have, next)."""
    return nodes.groupBy("client_id").agg(F.count_distinct("tree_id").cast("int").alias("have"), (F.max("tree_id") + 1).alias("next"))


def grow_forests(nodes: DataFrame | None, train: DataFrame, clients: Sequence[int], target: int, depth: int, seed: int, round_no: int, key: str = "key") -> DataFrame:
    """Keep every client's trees and grow new ones on its own rows up to the target, for all clients together.

    `nodes` is one forest per client, or a single global one (client_id null) that all clients start from; without it
    every client starts anew. New trees are numbered after the client's last one.
    """
    if nodes is None:
        return fit_forests(train, clients, target, depth, seed, round_no, key)
    spark = train.sparkSession
    ids = F.array(*[F.lit(c) for c in clients]).cast("array<int>")
    shared = nodes.where("client_id is null").drop("client_id").withColumn("client_id", F.explode(ids))
    kept = nodes.where(F.col("client_id").isin(list(clients))).unionByName(shared).withColumn("round", F.lit(round_no)).select(*NODES_SCHEMA.names)
    ledger = tree_ledger(kept)
    plan = plan_table(spark, clients, 0, target).select("client_id").join(ledger, "client_id", "left")
    missing = F.greatest(F.lit(0), F.lit(target) - F.coalesce("have", F.lit(0)))
    plan = settle(plan.select("client_id", F.coalesce("next", F.lit(0)).alias("first"), missing.alias("trees"))).df
    return kept.unionByName(fit_trees(train, plan, depth, seed, round_no, key))


def grow_forest(nodes: DataFrame, df: DataFrame, target: int, depth: int, seed: int, client: int, round_no: int, key: str = "key") -> DataFrame:
    """`grow_forests` for one forest and the rows of one client."""
    own = nodes.withColumn("client_id", F.lit(client)).select(*NODES_SCHEMA.names)
    return grow_forests(own, df.withColumn("client_id", F.lit(client)), [client], target, depth, seed, round_no, key)


def merge_forests(nodes: DataFrame) -> DataFrame:
    """All trees of all clients as one forest per round; trees are renumbered by (client, tree)."""
    trees = nodes.select("round", "client_id", "tree_id").distinct()
    numbers = numbered(trees, ["round"], [("client_id", "ascending"), ("tree_id", "ascending")], "merged")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("round", "client_id", "tree_id")]
    joined = nodes.alias("a").join(numbers.side().alias("b"), reduce(Column.__and__, same))
    kept = [F.col(f"a.{c}") for c in NODES_SCHEMA.names if c not in ("client_id", "tree_id")]
    return joined.select(F.lit(None).cast("int").alias("client_id"), F.col("b.merged").cast("int").alias("tree_id"), *kept).select(*NODES_SCHEMA.names)


def target_trees(nodes: DataFrame, trees: int | None = None) -> DataFrame:
    """Tree count to prune to: as given, else half of all trees but at least ten."""
    total = F.count_distinct("client_id", "tree_id") if trees is None else None
    rule = F.greatest(F.lit(10), F.floor(total / 2)) if trees is None else F.lit(trees)
    return nodes.agg(F.count_distinct("client_id", "tree_id").alias("total_trees"), rule.cast("int").alias("target"))


def _tree_blocks(nodes: DataFrame) -> Iterator[tuple[int, int, int, int]]:
    """Runs of trees (first, last, trees, nodes) that stay under the pass limit; trees are kept whole."""
    block: tuple[int, int, int, int] | None = None
    for row in nodes.groupBy("tree_id").agg(F.count("*").alias("size")).orderBy("tree_id").toLocalIterator():
        tree, size = row["tree_id"], row["size"]
        if block and block[3] + size <= PASS_NODES:
            block = (block[0], tree, block[2] + 1, block[3] + size)
        else:
            if block:
                yield block
            block = (tree, tree, 1, size)
    if not block:
        raise ValueError("empty forest")
    yield block


def _block_rows(nodes: DataFrame, block: tuple[int, int, int, int]) -> list[Row]:
    columns = ("tree_id", "node_id", "feature", "threshold", "left", "right", "counts")
    return nodes.where(F.col("tree_id").between(block[0], block[1])).select(*columns).collect()


def _leaf_ranges(rows: list[Row]) -> tuple[list[int], dict[str, np.ndarray]]:
    """Trees as arrays: leaves numbered from left to right, and for each split the leaves below its left side.

    A row whose value is above a split's threshold cannot end in those leaves. Once all such leaves are ruled out, the
    first leaf left is the one the row reaches.
    """
    by_tree: dict[int, dict[int, Row]] = {}
    for r in rows:
        by_tree.setdefault(r["tree_id"], {})[r["node_id"]] = r
    ids = sorted(by_tree)
    splits: list[tuple[int, int, float, int, int]] = []  # tree, feature, threshold, first and last + 1 leaf on the left
    shares: list[list[float]] = []
    for t, tree in enumerate(ids):
        nodes, own, stack = by_tree[tree], [], [(min(by_tree[tree]), None)]
        while stack:
            node, opened = stack.pop()
            r = nodes.get(node)
            if opened is not None:  # everything on the left of this split has been numbered
                splits.append((t, r["feature"], r["threshold"], opened, len(own)))
            elif r["left"] < 0:
                total = sum(r["counts"])
                own.append(r["counts"][1] / total if total else 0.0)
            else:
                stack += [(r["right"], None), (node, len(own)), (r["left"], None)]
        shares.append(own)
    tree, feature, threshold, low, high = (np.array(c) for c in zip(*splits, strict=True)) if splits else (np.zeros(0, int),) * 5
    size = np.array([len(s) for s in shares])
    return ids, {
        "tree": tree.astype(np.int64), "feature": feature.astype(np.int64), "threshold": threshold.astype(np.float64), "low": low.astype(np.int64), "high": high.astype(np.int64),
        "leaves": size, "base": np.cumsum(size) - size, "share": np.concatenate(shares),
    }


def _masked(rows: list[Row], budget: int | None = None):
    """Tree ids, and a function from a row matrix to (first tree, class-1 shares of rows x some trees), slice by slice.

    The thresholds of a feature are sorted, and for each place in that order a table has the leaves every tree of the slice
    still allows, as bits. A row finds its place once per feature and takes the intersection of what its features allow.
    Tables and intermediate arrays stay within `budget` bytes, however many trees there are.
    """
    ids, forest = _leaf_ranges(rows)
    budget = budget or MASK_BYTES
    words = int(-(-forest["leaves"].max() // 64))
    # All slices' tables together: (splits + features) x trees of a slice x words x 8.
    entries = len(forest["tree"]) + len(np.unique(forest["feature"])) * 8 + 1
    width = int(max(1, min(len(ids), budget // (16 * words * entries))))
    step = int(max(1, budget // (32 * words * width)))

    def tables() -> list[tuple]:
        made = []
        order = {f: (own := np.flatnonzero(forest["feature"] == f))[np.argsort(forest["threshold"][own], kind="stable")] for f in np.unique(forest["feature"]).tolist()}
        for first in range(0, len(ids), width):
            last, parts = min(first + width, len(ids)), []
            for f, split in order.items():
                inside = (forest["tree"][split] >= first) & (forest["tree"][split] < last)
                own = split[inside]
                if not len(own):
                    continue
                trees, column = np.unique(forest["tree"][own], return_inverse=True)
                allowed = np.full((len(own) + 1, len(trees), words), np.uint64(0xFFFFFFFFFFFFFFFF))
                for k, (s, c) in enumerate(zip(own.tolist(), column.tolist(), strict=True)):
                    allowed[k + 1] = allowed[k]
                    low, high = int(forest["low"][s]), int(forest["high"][s])
                    gone = (1 << high) - (1 << low)
                    allowed[k + 1, c] &= np.array([~(gone >> (64 * w)) & 0xFFFFFFFFFFFFFFFF for w in range(words)], np.uint64)
                # Places among all thresholds of the feature to places among those of the slice.
                parts.append((f, np.append(0, np.cumsum(inside)), trees - first, allowed))
            made.append((first, last, parts))
        return [{f: forest["threshold"][o] for f, o in order.items()}, made]

    held: list = []

    def score(x):
        if not held:
            held.extend(tables())
        thresholds, made = held
        for at in range(0, len(x), step):
            part = x[at : at + step]
            place = {f: np.searchsorted(t, part[:, f], side="left") for f, t in thresholds.items()}
            for first, last, parts in made:
                left = np.full((len(part), last - first, words), np.uint64(0xFFFFFFFFFFFFFFFF))
                for f, local, trees, allowed in parts:
                    left[:, trees] &= allowed[local[place[f]]]
                word = (left != 0).argmax(axis=2)
                bits = np.take_along_axis(left, word[:, :, None], axis=2)[:, :, 0]
                leaf = 64 * word + np.frexp((bits & (~bits + np.uint64(1))).astype(np.float64))[1] - 1
                yield at, first, forest["share"][forest["base"][first:last] + leaf]

    return ids, score


def tree_scores(nodes: DataFrame, test: DataFrame) -> DataFrame:
    """Accuracy of each tree on the test rows: (tree_id, hits, rows, score).

    One pass per block of trees; each task adds up the hits of its own rows. The driver holds one block at a time.
    """
    parts = []
    for block in _tree_blocks(nodes):
        hits = _score_block(_block_rows(nodes, block), test)
        parts.append(settle(hits.groupBy("tree_id").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))).df)
    scored = reduce(DataFrame.unionByName, parts)
    return scored.withColumn("score", F.when(F.col("rows") > 0, F.col("hits") / F.col("rows")).otherwise(F.lit(0.0)))


def _score_block(rows: list[Row], test: DataFrame) -> DataFrame:
    ids, score = _masked(rows)

    def partial(batches):
        hits, seen = np.zeros(len(ids), dtype=np.int64), 0
        for batch in batches:
            y = batch.column("label").to_numpy()
            if len(y) == 0:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
            for at, first, share in score(x):
                # A tie between the classes goes to class 0.
                own = y[at : at + len(share), None] == 1
                hits[first : first + share.shape[1]] += ((share > 0.5) == own).sum(axis=0)
            seen += len(y)
        yield pa.RecordBatch.from_pydict({
            "tree_id": pa.array(ids, pa.int32()),
            "hits": pa.array(hits, pa.int64()),
            "rows": pa.array([seen] * len(ids), pa.int64()),
        })

    return test.select("label", "x").mapInArrow(partial, "tree_id INT, hits BIGINT, rows BIGINT")


def prune_forest(nodes: DataFrame, scores: DataFrame, trees: int) -> DataFrame:
    """Keep the best trees, ties to the later tree, renumbered from the lowest kept score up."""
    places = numbered(scores.select("tree_id", "score"), [], [("score", "descending"), ("tree_id", "descending")], "place")
    kept = min(trees, places.rows.num_rows if places.rows is not None else places.df.count())
    best = Settled(places.df.where(F.col("place") < kept).select("tree_id", (F.lit(kept - 1) - F.col("place")).cast("int").alias("kept")), places.rows)
    joined = nodes.join(best.side(), "tree_id")
    return joined.drop("tree_id").withColumnRenamed("kept", "tree_id").select(*NODES_SCHEMA.names)


def merge_and_prune(nodes: DataFrame, test: DataFrame, trees: int | None = None) -> DataFrame:
    """One forest of the best trees of all clients of a round."""
    merged = settle(merge_forests(nodes), limit=PASS_NODES).df
    wanted = trees if trees is not None else target_trees(nodes).first()["target"]
    return prune_forest(merged, tree_scores(merged, test), wanted)


def tree_expression(rows: list[Row], x: Column) -> Column:
    """Class-1 share of one tree as nested conditions."""
    nodes = {r["node_id"]: r for r in rows}

    def build(node_id: int) -> Column:
        r = nodes[node_id]
        if r["left"] < 0:
            total = sum(r["counts"])
            return F.lit(float(r["counts"][1] / total if total else 0.0))
        return F.when(F.get(x, F.lit(r["feature"])) <= F.lit(r["threshold"]), build(r["left"])).otherwise(build(r["right"]))

    return build(min(nodes))


def nodes_to_expr(nodes: DataFrame, x: str = "x") -> Column:
    """A whole forest as one expression: the mean of its trees' class-1 shares."""
    rows = nodes.limit(EXPRESSION_NODES + 1).collect()
    if len(rows) > EXPRESSION_NODES:
        raise ValueError("forest too large for one expression; use forest_proba")
    return _forest_expression(rows, x)


def _forest_expression(rows: list[Row], x: str) -> Column:
    ids = sorted({r["tree_id"] for r in rows})
    shares = [tree_expression([r for r in rows if r["tree_id"] == t], F.col(x)) for t in ids]
    return reduce(Column.__add__, shares) / F.lit(float(len(ids)))


def forest_proba(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add `proba` (mean leaf share of class 1) and `pred` (the larger class, ties to 0).

    A small forest stays in generated code; a larger one is scored batch by batch with leaf masks.
    """
    blocks = list(_tree_blocks(nodes))
    trees, size = sum(b[2] for b in blocks), sum(b[3] for b in blocks)
    if trees <= EXPRESSION_TREES and size <= EXPRESSION_NODES:
        scored = df.withColumn("proba", _forest_expression(_block_rows(nodes, blocks[0]), "x"))
    else:
        scored = df.withColumn("proba", F.lit(0.0))
        for block in blocks:
            scored = _add_shares(scored, _block_rows(nodes, block))
        scored = scored.withColumn("proba", F.col("proba") / F.lit(float(trees)))
    return scored.withColumn("pred", (F.col("proba") > 0.5).cast("int"))


def _add_shares(df: DataFrame, rows: list[Row]) -> DataFrame:
    _, score = _masked(rows)
    at = df.columns.index("proba")

    def add(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            total = batch.column("proba").to_numpy().copy()
            for begin, _, share in score(x):
                total[begin : begin + len(share)] += share.sum(axis=1)
            yield batch.set_column(at, batch.schema.field("proba").name, pa.array(total, pa.float64()))

    fields = [StructField("proba", DoubleType()) if f.name == "proba" else f for f in df.schema.fields]
    return df.mapInArrow(add, StructType(fields))


def feature_importance(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Importance of every feature: gain times rows, normalised per tree, averaged, summing to 1."""
    splits = nodes.where(F.col("left") >= 0)
    per_tree = splits.groupBy("client_id", "tree_id", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    tree = Window.partitionBy("client_id", "tree_id")
    shares = per_tree.withColumn("g", F.col("g") / F.sum("g").over(tree)).groupBy("feature").agg(F.sum("g").alias("g"))
    names = F.array(*[F.lit(n) for n in features])
    known = nodes.sparkSession.range(1).select(F.posexplode(names).alias("i", "Feature"))
    joined = known.join(shares.withColumnRenamed("feature", "i"), "i", "left")
    value = F.coalesce(F.col("g"), F.lit(0.0))
    total = F.sum(value).over(Window.partitionBy(F.lit(0)))
    return joined.select("Feature", F.when(total > 0, value / total).otherwise(F.lit(0.0)).alias("Importance")).orderBy(
        F.col("Importance").desc(), "Feature"
    )
