"""Exact top-k by inner product: cover trees over queries and data, searched together."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shardwise.llm.store import release, written

PART_POINTS = 8192
BLOCK_QUERIES = 1024
#: Points that are compared as a whole. A group of queries searches as wide as its farthest members, so theirs are smaller.
DATA_LEAF, QUERY_LEAF = 64, 8
#: Points on the driver that place data in parts and give queries a first bound.
PIVOTS, SEEDS = 64, 512
#: Doubles add up whole numbers exactly below this.
EXACT = 2.0**52


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x, dim) with x = floor(scale * component), for vectors of finite components only."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * float(scale))).alias("x"))
    return rows.withColumn("dim", F.size("x"))


def largest_score(rows: DataFrame) -> tuple[float, float]:
    """What no score of these vectors exceeds, and no component; floor() has cut what a long cannot hold, which shows in both."""
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    found = rows.agg(F.max(norm).alias("norm"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double"))))).alias("peak")).first()
    return found["norm"] or 0.0, found["peak"] or 0.0


class CoverTree:
    """Nested nets over points. Level i has centres more than R / 2^i apart, from all parts of the tree, and every point
    within R / 2^i of one; a centre stays one on all lower levels, and its parent is the nearest centre a level up.

    The nets are the beginnings of one farthest-first traversal, which ends once there are two centres for `leaf` points. A node
    keeps the covering radius of the points below it, which are one range of the order; with `leaf` points or fewer it is searched whole.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = DATA_LEAF):
        x = points.astype(np.float64)
        near = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
        centres, reach, own = [0], [float(near.max())], np.zeros(len(x), np.int64)
        while len(centres) * leaf < 2 * len(x) and near[k := int(near.argmax())] > 0:
            far = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
            reach.append(float(near[k]))
            closer = far < near
            own[closer], near = len(centres), np.where(closer, far, near)
            centres.append(k)
        at = x[centres]
        with np.errstate(divide="ignore"):
            level = np.where(np.arange(len(centres)) == 0, 0, np.floor(np.log2(max(reach[0], 1e-300) / np.array(reach))).astype(np.int64) + 1)
        below: dict[int, dict[int, list[int]]] = {}
        for k in range(1, len(centres)):
            above = np.flatnonzero(level < level[k])
            parent = int(above[((at[above] - at[k]) ** 2).sum(axis=1).argmin()])
            below.setdefault(parent, {}).setdefault(int(level[k]), []).append(k)
        members = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(centres)))[:-1])
        order: list[int] = []
        nodes: list[list] = []  # centre, begin, end, children

        def open_node(k: int, depth: int) -> tuple[int, list[tuple[int, int]]]:
            nodes.append([k, len(order), 0, []])
            further = [d for d in below.get(k, {}) if d > depth]
            if not further:
                order.extend(members[k].tolist())
                nodes[-1][2] = len(order)
                return len(nodes) - 1, []
            d = min(further)
            return len(nodes) - 1, [(k, d), *[(c, d) for c in below[k][d]]]

        stack = [(*open_node(0, -1), 0)]
        while stack:
            me, inner, done = stack.pop()
            if done < len(inner):
                stack.append((me, inner, done + 1))
                child, below_it = open_node(*inner[done])
                nodes[me][3].append(child)
                stack.append((child, below_it, 0))
            else:
                nodes[me][2] = len(order)
        self.ids, self.points, self.leaf = ids[order], points[order], leaf
        self.centres = at[[n[0] for n in nodes]]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.begins = [n[1] for n in nodes]
        self.sizes = [n[2] - n[1] for n in nodes]
        self.children = [n[3] for n in nodes]
        y = x[order]
        self.radii = np.array([np.sqrt(((y[n[1] : n[2]] - at[n[0]]) ** 2).sum(axis=1).max()) * (1 + 1e-12) for n in nodes])

    def save(self) -> bytes:
        return pickle.dumps(self.__dict__, protocol=5)

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(data)
        return tree


class Best:
    """The k best (score, id) of each query so far; `kth` is the score a newcomer must reach."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray):
        self.queries, self.k, self.kth = queries, k, floor.copy()
        self.scores = [np.empty(0, np.int64) for _ in queries]
        self.ids = [np.empty(0, np.int64) for _ in queries]

    def offer(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.kth[at : at + len(scores), None]).any(axis=1)).tolist():
            q = at + i
            fit = (scores[i] >= self.kth[q]) & (ids != self.queries[q])
            s, d = np.concatenate([self.scores[q], scores[i][fit]]), np.concatenate([self.ids[q], ids[fit]])
            order = np.lexsort((d, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], d[order]
            if len(order) == self.k:
                self.kth[q] = max(self.kth[q], s[order[-1]])


def search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray, exact: bool = False) -> tuple[Best, int]:
    """Dual-tree search; also the number of point pairs compared.

    A pair of nodes is left out when no point of one can reach, with any query of the other, the worst kth
    score of that group: <q, c> + rq |c| + rc |q| + rq rc bounds every inner product between them.
    """
    best, compared = Best(queries.ids, k, floor), 0
    kind = np.float64 if exact else np.int64  # whole numbers either way
    q_points, c_points = queries.points.astype(kind), data.points.astype(kind)

    def bounds(q: int, nodes: list[int]) -> np.ndarray:
        dots = data.centres[nodes] @ queries.centres[q]
        top = dots + queries.radii[q] * data.norms[nodes] + data.radii[nodes] * queries.norms[q] + queries.radii[q] * data.radii[nodes]
        return top + 1e-9 * np.abs(top) + 1e-6 * (1 + queries.norms[q] * data.norms[nodes])  # rounding

    stack = [(0, 0, float(bounds(0, [0])[0]))]
    while stack:
        q, c, top = stack.pop()
        q_at, q_end = queries.begins[q], queries.begins[q] + queries.sizes[q]
        if top < best.kth[q_at:q_end].min():
            continue
        q_inner = queries.children[q] if queries.sizes[q] > queries.leaf else []
        c_inner = data.children[c] if data.sizes[c] > data.leaf else []
        if not q_inner and not c_inner:
            c_at, c_end = data.begins[c], data.begins[c] + data.sizes[c]
            best.offer(q_at, (q_points[q_at:q_end] @ c_points[c_at:c_end].T).astype(np.int64), data.ids[c_at:c_end])
            compared += (q_end - q_at) * (c_end - c_at)
        elif c_inner and (not q_inner or data.radii[c] >= queries.radii[q]):
            tops = bounds(q, c_inner)
            stack += [(q, c_inner[i], float(tops[i])) for i in np.argsort(tops).tolist()]  # the best comes off first
        else:
            stack += [(i, c, float(bounds(i, [c])[0])) for i in q_inner]
    return best, compared


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _trees(rows: DataFrame, size: int, pivots: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int, leaf: int) -> DataFrame:
    """Rows (vec_id, x) of one dimension to trees of at most `size` points each, near ones together."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.astype(np.float64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1)).astype(np.float64)
                far = (p**2).sum(axis=1) - 2 * (x @ p.T)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.argmin(axis=1), pa.int32())], ["vec_id", "x", "pivot"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held, made = [], [], 0, 0

        def tree() -> pa.RecordBatch:
            t = CoverTree(np.concatenate(ids), np.concatenate(points), leaf)
            seed_ids, seed_points = seeds
            floor = np.full(len(t.ids), np.iinfo(np.int64).min)
            best = Best(t.ids, k, floor)
            best.offer(0, t.points.astype(np.int64) @ seed_points.astype(np.int64).T, seed_ids)
            name = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([t.points.shape[1]], pa.int32()), pa.array([t.save()], pa.binary()), pa.array([best.kth.tobytes()], pa.binary())], ["tree", "dim", "data", "kth"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if held and held + part.num_rows > size:
                    yield tree()
                    ids, points, held, made = [], [], 0, made + 1
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                points.append(_matrix(part.column(1)))
                held += part.num_rows
        if held:
            yield tree()

    kinds = rows.select("vec_id", "x").schema
    placed = rows.select("vec_id", "x").mapInArrow(place, StructType(kinds.fields + [StructField("pivot", IntegerType())]))
    parts = max(1, -(-rows.count() // size))
    ranged = placed.repartitionByRange(parts, "pivot", F.xxhash64("vec_id")).select("vec_id", "x")
    return written(ranged.mapInArrow(build, "tree long, dim int, data binary, kth binary"), "cover-trees")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, part_points: int = PART_POINTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of `vectors` by integer inner product.

    Components become floor(scale * x); rows with the query's own id do not count; ties go to smaller ids. Of
    equal vectors only the k + 1 smallest ids can be among the best, so only they go into trees. Trees of
    bounded size hold near vectors. Each is sent once, held by a task, and searched together with every query tree of its
    dimension, which stream past it; the best of each pair of trees are merged.

    Vectors that are null, empty, or hold null or non-finite components take no part, as query or candidate, nor
    do rows without id. Repeated rows count once. Vectors of other dimension never meet. Scores are exact: if one may not
    fit 64 bits the job ends with an error before it compares anything. Fewer than k candidates give fewer rows; an empty
    table gives none.
    """
    raw = [integers(t, id_col, vector_col, scale) for t in (vectors, queries)]
    norms, peaks = zip(*(largest_score(t) for t in raw), strict=True)
    if max(norms) >= 2.0**62:
        raise ValueError("components are too large: a score may not fit 64 bits")
    kind = "array<int>" if max(peaks) < 2**31 else "array<long>"
    data, asked = (written(t.withColumn("x", F.col("x").cast(kind)).dropDuplicates(["vec_id", "x"]), name) for t, name in zip(raw, ("cover-data", "cover-queries"), strict=True))
    same = Window.partitionBy("x").orderBy("vec_id")
    slim = written(data.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "cover-points")
    found, built = None, []
    for (dim,) in asked.select("dim").distinct().collect():
        points, wanted = slim.where(F.col("dim") == dim), asked.where(F.col("dim") == dim)
        sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow()
        if not sample.num_rows:
            continue
        ids, x = sample.column("vec_id").to_numpy(), _matrix(sample.column("x").combine_chunks())
        trees = _trees(points, part_points, x[:PIVOTS], (ids[:0], x[:0]), k, DATA_LEAF)
        blocks = _trees(wanted, BLOCK_QUERIES, x[:PIVOTS], (ids, x), k, QUERY_LEAF)
        built += [trees, blocks]
        part = _searched(blocks, trees, k, max(norms) < EXACT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, compared long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = written(best.select("query_id", "rank", "vec_id", "score"), "cover-best")
    for table in (data, asked, slim, *built):
        release(table)
    return out


def _searched(blocks: DataFrame, trees: DataFrame, k: int, exact: bool) -> DataFrame:
    """The best of each query in each data tree. The stated query set meets all rows, tree by tree."""
    numbers = trees.groupBy("dim").agg(F.collect_list("tree").alias("trees"))  # a number for thousands of vectors
    copies = blocks.join(numbers, "dim").select(F.explode("trees").alias("tree"), F.lit(1).alias("kind"), "data", "kth")
    both = trees.select("tree", F.lit(0).alias("kind"), "data", "kth").unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for i in range(batch.num_rows):
                tree = CoverTree.load(batch.column(2)[i].as_py())
                if batch.column(1)[i].as_py() == 0:
                    data = tree
                    continue
                best, compared = search(tree, data, k, np.frombuffer(batch.column(3)[i].as_py(), np.int64), exact)
                n = [len(s) for s in best.scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.queries, n), pa.int64()), pa.array(np.concatenate(best.ids), pa.int64()), pa.array(np.concatenate(best.scores), pa.int64()), pa.array(np.full(sum(n), compared), pa.int64())], ["query_id", "vec_id", "score", "compared"])

    return both.repartition("tree").sortWithinPartitions("tree", "kind").mapInArrow(run, "query_id long, vec_id long, score long, compared long")
