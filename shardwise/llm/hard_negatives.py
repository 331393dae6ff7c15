"""Hard negatives by inner product: vertical scans of vectors, dimension by dimension, until few candidates are left."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwise.llm.cover_search import EXACT, largest_score
from shardwise.llm.store import release, written

#: Vectors in one columnar block: between these, with about PARTS blocks between the two.
FEWEST, MOST, PARTS = 2_048, 262_144, 256
#: Anchors that travel as one row.
ANCHORS = 128
#: Shares of the dimensions after which candidates are ruled out.
STOPS = (0.125, 0.25, 0.5, 0.75)


def integers(vectors: DataFrame, anchor, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """Rows (vec_id, label, mark, dim, x, anchor), x = floor(scale * component), for labelled vectors of finite components only; repeated rows once."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = float(2**62)
    cell = lambda c: F.greatest(F.least(F.floor(c * float(scale)).cast("double"), F.lit(large)), F.lit(-large)).cast("long")
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(v, cell).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.select("vec_id", "label", F.xxhash64("label", "x").alias("mark"), F.size("x").alias("dim"), "x", "anchor")
    return rows.groupBy("vec_id", "label", "mark", "dim", "x").agg(F.max("anchor").alias("anchor")).select("vec_id", "label", "mark", "dim", "x", "anchor")


class Columns:
    """A block of vectors, a row for each dimension, with the least and the greatest value of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, exact: bool):
        self.ids, self.labels = ids, labels
        self.values = np.ascontiguousarray(x.T.astype(np.float64 if exact else np.int64))
        self.least, self.greatest = self.values.min(axis=1), self.values.max(axis=1)
        self.read = 0


def vertical_scan(block: Columns, x: np.ndarray, alive: np.ndarray, wanted: Callable[[np.ndarray, float, float], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block and exact scores of the candidates in the bitmap `alive` that are not ruled out.

    Dimensions are read in the order of the anchor's falling magnitudes. What the rest can add lies between the sums of
    their least and greatest contributions, so wanted(sums, least rest, greatest rest) can clear candidates long before all is read.
    """
    x = x.astype(block.values.dtype)
    order = np.argsort(-np.abs(x), kind="stable")
    ends = x * block.least, x * block.greatest
    low, high = np.minimum(*ends)[order], np.maximum(*ends)[order]
    rest_low, rest_high = (np.append(np.cumsum(c[::-1])[::-1], 0) for c in (low, high))
    at = np.flatnonzero(alive)
    sums = np.zeros(len(at), block.values.dtype)
    begin = 0
    for end in sorted({max(1, int(len(x) * s)) for s in STOPS} | {len(x)}):
        if not len(at):
            break
        dims = order[begin:end]
        part = block.values[dims] if len(at) == block.values.shape[1] else block.values[np.ix_(dims, at)]
        sums += x[dims] @ part
        block.read += part.size
        begin = end
        if end < len(x):
            keep = wanted(sums, rest_low[end], rest_high[end])
            alive[at[~keep]] = False
            if keep.sum() < 0.9 * len(at):
                at, sums = at[keep], sums[keep]
    keep = alive[at]
    return at[keep], sums[keep]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest(block: Columns, vec_id: int, label: int, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's k best rows of the same label, the anchor's own id left out."""

    def wanted(sums: np.ndarray, low: float, high: float) -> np.ndarray:
        if len(sums) <= k:
            return np.ones(len(sums), bool)
        return sums + high >= np.partition(sums, -k)[-k] + low

    at, scores = vertical_scan(block, x, (block.labels == label) & (block.ids != vec_id), wanted)
    top = _best(block.ids[at], scores, k)
    return block.ids[at[top]], scores[top].astype(np.int64)


def between(block: Columns, vec_id: int, label: int, x: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window (lowest, highest score): its number, ids and scores of the block's k best rows of other labels inside."""

    def wanted(sums: np.ndarray, low: float, high: float) -> np.ndarray:
        keep = np.zeros(len(sums), bool)
        for a, b in windows:
            if a <= b:
                sure = sums[(sums + low >= a) & (sums + high <= b)]
                floor = max(a, np.partition(sure, -k)[-k] + low) if len(sure) >= k else a
                keep |= (sums + high >= floor) & (sums + low <= b)
        return keep

    at, scores = vertical_scan(block, x, (block.labels != label) & (block.ids != vec_id), wanted)
    for number, (a, b) in enumerate(windows):
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        top = inside[_best(block.ids[at[inside]], scores[inside], k)]
        yield number, block.ids[at[top]], scores[top].astype(np.int64)


def _packed(rows: DataFrame, size: int, fields: list[str], make: Callable[[dict], bytes]) -> DataFrame:
    """Rows sorted by dim, `size` of one dim at a time, as rows (dim, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, dim = 0, None

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            data = make({f: t.column(f).to_pylist() for f in fields} | {"x": x})
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([data], pa.binary())], ["dim", "data"])

        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, size):
                    part = batch.slice(at, min(size, b - at))
                    if held and (dims[a] != dim or count + part.num_rows > size):
                        yield row()
                        held, count = [], 0
                    held.append(part)
                    count, dim = count + part.num_rows, int(dims[a])
        if held:
            yield row()

    return rows.mapInArrow(run, "dim int, data binary")


def _matrix(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if len(x) and np.abs(x).max() < 2**31 else x


def _scan(blocks: DataFrame, asked: DataFrame, exact: bool, answer: Callable[[Columns, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Every block against every pack of anchors of its dimension: a block is held, packs stream past it."""
    numbers = blocks.groupBy("dim").agg(F.collect_list("number").alias("numbers"))  # PARTS or so, or rows / MOST
    copies = asked.join(numbers, "dim").select(F.explode("numbers").alias("number"), F.lit(1).alias("kind"), "data")
    both = blocks.select("number", F.lit(0).alias("kind"), "data").unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                data = pickle.loads(batch.column(2)[i].as_py())
                if batch.column(1)[i].as_py() == 0:
                    block = Columns(data["vec_id"], data["label"], data["x"], exact)
                elif rows := list(answer(block, data)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return both.repartition("number").sortWithinPartitions("number", "kind").mapInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, anchor=None, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), the score is their inner product. For each row where `anchor` (a condition; without it every
    row) holds, its `positives` best other rows of its label; for each of these the `negatives` best rows of other labels whose
    score is between `lowest` and `highest` percent of the positive's. Ties go to smaller ids.

    Vectors lie in columnar blocks, near labels together; anchors stream past every block of their dimension, first for the
    positives, then with the windows of all their positives at once. Scores are whole numbers, added as doubles where no
    score can reach 2**52, else as longs; if one may not fit a long, the job ends with an error before it compares anything.

    Rows without id or label, and vectors that are null, empty or hold null or non-finite components, take no part. Equal
    rows count once; other rows with the anchor's id are never its candidates; rows that share an id are anchors, positives
    and negatives each for themselves. Vectors of other dimension never meet. Anchors without positive give no row, as does an empty table.
    """
    rows = written(integers(vectors, F.lit(True) if anchor is None else anchor, id_col, vector_col, label_col, scale), "negatives-rows")
    total, _ = largest_score(rows)  # also bounds every sum of some of a score's terms
    if total >= 2.0**62:
        raise ValueError("components are too large: a score may not fit 64 bits")
    exact, dims = total < EXACT, rows.select("dim").distinct().count()
    size = block_rows or int(min(MOST, max(FEWEST, rows.count() // PARTS)))
    parts = max(1, -(-rows.count() // size)) + dims
    sorted_rows = rows.repartitionByRange(parts, "dim", "label", "mark").sortWithinPartitions("dim", "label")
    pack = lambda t: pickle.dumps({"vec_id": np.array(t["vec_id"], np.int64), "label": np.array(t["label"], np.int64), "x": _matrix(t["x"])}, protocol=5)
    blocks = written(_packed(sorted_rows, size, ["vec_id", "label"], pack).withColumn("number", F.monotonically_increasing_id()), "negatives-blocks")
    asking = rows.where("anchor").drop("anchor")
    keyed = lambda t: pickle.dumps({k: t[k] for k in t if k != "x"} | {"x": _matrix(t["x"])}, protocol=5)
    first = _packed(asking.repartition("dim").sortWithinPartitions("dim") if dims > 1 else asking, ANCHORS, ["vec_id", "label", "mark"], keyed)

    def friends(block: Columns, t: dict) -> Iterator[tuple]:
        held = set(np.unique(block.labels).tolist())
        for i, (vec_id, label, mark) in enumerate(zip(t["vec_id"], t["label"], t["mark"], strict=True)):
            if label in held:
                for p, s in zip(*nearest(block, vec_id, label, t["x"][i], positives), strict=True):
                    yield vec_id, mark, int(p), int(s)

    found = _scan(blocks, written(first, "negatives-anchors"), exact, friends, "vec_id long, mark long, positive_id long, positive_score long")
    order = Window.partitionBy("vec_id", "mark").orderBy(F.desc("positive_score"), "positive_id")
    ranked = found.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives)
    near = written(ranked.groupBy("vec_id", "mark").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("near")), "negatives-positives")
    again = asking.join(near.select("vec_id", "mark", F.col("near.positive_score").alias("scores")), ["vec_id", "mark"])
    second = _packed(again.repartition("dim").sortWithinPartitions("dim") if dims > 1 else again, ANCHORS, ["vec_id", "label", "mark", "scores"], keyed)

    def foes(block: Columns, t: dict) -> Iterator[tuple]:
        for i, (vec_id, label, mark, scores) in enumerate(zip(t["vec_id"], t["label"], t["mark"], t["scores"], strict=True)):
            windows = [(-(-lowest * s // 100), highest * s // 100) for s in scores]
            for number, ids, own in between(block, vec_id, label, t["x"][i], windows, negatives):
                for n, s in zip(ids, own, strict=True):
                    yield vec_id, mark, number + 1, int(n), int(s)

    against = _scan(blocks, written(second, "negatives-windows"), exact, foes, "vec_id long, mark long, positive_rank long, negative_id long, negative_score long")
    order = Window.partitionBy("vec_id", "mark", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    best = against.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = near.select("vec_id", "mark", F.explode("near").alias("p")).select("vec_id", "mark", "p.*").withColumn("positive_rank", F.col("positive_rank").cast("long"))
    out = best.join(named, ["vec_id", "mark", "positive_rank"])
    out = written(out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for table in (rows, blocks, near):
        release(table)
    return out
