"""The tree of all conversations' beginnings, with totals of every subtree passed upwards."""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.llm.store import release, utf8, written

#: Conversations of one hundred share the first turns of its first one, as many as a CRC-32 modulo this says.
FAMILY, SHARED_TURNS = 100, 6
#: Turns from a node on that a shard may hold; the next level of shards holds WIDER times as many, and so on.
SHARD_TURNS, WIDER = 20_000, 64
#: Turns of a conversation that one task numbers or sums at a time.
STRETCH = 256
#: Messages a queue holds in memory.
QUEUE = 100_000
_CHUNK = 1 << 16


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns in order, from 0. Long conversations are counted in stretches of turn numbers."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(role).cast("string")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(utf8(F.concat(size, F.lit(":"), role, text)), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**63))))
    counts = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    placed = rows.withColumn("at", F.row_number().over(own) - 1).join(before, ["conv_id", "stretch"])
    return placed.select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "digest", "chars")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, length, depth, digest, chars) of the rebuilt conversations, and (conv_id, length) of all of them."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    crc = F.crc32(utf8(F.col("conv_id").cast("string")))
    info = sizes.select("conv_id", "n", F.pmod(crc, F.lit(SHARED_TURNS)).alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    info = info.join(bases, "base", "left").withColumn("g", F.least("h", F.coalesce("base_n", F.lit(0))))
    info = info.select("conv_id", "base", "h", "g", (F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    own = turns.join(info.drop("base"), "conv_id").where("pos >= h")
    own = own.select("conv_id", "length", (F.col("g") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "chars")
    heads = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < SHARED_TURNS)).withColumnRenamed("conv_id", "base")
    given = heads.join(info.drop("g"), "base").where("pos < h").select("conv_id", "length", (F.col("pos") + 1).alias("depth"), "digest", "chars")
    return own.unionByName(given), info.select("conv_id", "length")


def paths(rows: DataFrame) -> DataFrame:
    """Every turn with the name of its node (a, b) and of the node above (pa, pb): 128 bits, the exclusive or of a hash of
    (depth, turn) over all turns so far. It is summed up in stretches, whose totals are summed in turn."""
    rows = rows.withColumns({"fa": F.xxhash64(F.lit("a"), "depth", "digest"), "fb": F.xxhash64(F.lit("b"), "digest", "depth", F.lit(7))})
    rows = rows.withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH)).drop("digest")
    totals = rows.where(F.col("length") > STRETCH).groupBy("conv_id", "stretch").agg(F.bit_xor("fa").alias("ta"), F.bit_xor("fb").alias("tb"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(t) for t in ("ta", "tb")])
    so_far = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor("fa").over(so_far), "b": F.bit_xor("fb").over(so_far)}).join(before, ["conv_id", "stretch"], "left")
    name = {x: F.col(x).bitwiseXOR(F.coalesce(f"t{x}", F.lit(0))) for x in ("a", "b")}
    return rows.select("conv_id", "length", "depth", "chars", *[name[x].alias(x) for x in name], *[name[x].bitwiseXOR(F.col(f"f{x}")).alias(f"p{x}") for x in name])


class SpillingQueue:
    """A priority queue of (key, value) rows of whole numbers; beyond `limit` rows it is sorted out to a file of the task.

    The file is nameless and gone with the task; a lost task begins anew from its rows.
    """

    def __init__(self, width: int, limit: int = QUEUE):
        self.width, self.limit, self.heap, self.runs = width, limit, [], []

    def push(self, row: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, row)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            np.array(sorted(self.heap), np.int64).tofile(file)
            file.seek(0)
            self.heap = []
            self._refill(self._read(file))

    def _read(self, file) -> Iterator[tuple[int, ...]]:
        with file:
            while len(part := np.fromfile(file, np.int64, 4096 * self.width)):
                yield from map(tuple, part.reshape(-1, self.width).tolist())

    def _refill(self, run: Iterator[tuple[int, ...]]) -> None:
        row = next(run, None)
        if row is not None:
            heapq.heappush(self.runs, (row, id(run), run))

    def first(self) -> tuple[int, ...] | None:
        return min([h[0] if h is self.heap else h[0][0] for h in (self.heap, self.runs) if h], default=None)

    def pop(self) -> tuple[int, ...]:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        row, _, run = heapq.heappop(self.runs)
        self._refill(run)
        return row


def _upwards(queue_limit: int):
    """Nodes in reverse level order, shard by shard: each takes the messages for it, then sends its totals to its parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(5, queue_limit)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            children, leaves, saved = [], [], []
            for i, (depth, a, b, n, chars) in enumerate(zip(*(column[c] for c in ("depth", "a", "b", "n_convs", "chars")), strict=True)):
                c, l, s = column["in_children"][i], column["in_leaves"][i], column["in_saved"][i] + (n - 1) * chars
                while (head := queue.first()) is not None and head[:3] == (-depth, a, b):
                    _, _, _, more, tokens = queue.pop()
                    c, l, s = c + 1, l + more, s + tokens
                l = l or 1  # noqa: E741
                children.append(c), leaves.append(l), saved.append(s)
                if (a, b) != (column["ta"][i], column["tb"][i]):
                    queue.push((1 - depth, column["pa"][i], column["pb"][i], l, s))
            kept = ["a", "b", "pa", "pb", "ta", "tb", "conv_id", "depth", "n_convs", "ends"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in kept] + [pa.array(x, pa.int64()) for x in (children, leaves, saved)], [*kept, "n_children", "n_leaves", "saved_tokens"])

    return run


def _shards(nodes: DataFrame, path: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes with level and (ta, tb), the top of their shard: the highest node above them of the same level.

    The level of a node says how many turns there are from it on. It never falls on the way up, so a shard is a connected
    part of the tree, and at no depth has it more than WIDER nodes, or `shard_turns` turns at level 0.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log(F.col("weight") / float(shard_turns)) / F.log(F.lit(float(WIDER))))).cast("int")
    nodes = nodes.withColumn("level", level)
    steps = path.select("conv_id", "depth", "a", "b").join(nodes.select("a", "b", "level"), ["a", "b"])
    tops = steps.groupBy("conv_id", "level").agg(F.min_by(F.struct("a", "b"), "depth").alias("top"))
    last = nodes.agg(F.max("level")).first()[0]
    nodes = nodes.join(tops, ["conv_id", "level"], "left")
    root = F.col("level") == F.lit(last)
    return nodes.select("*", *[F.when(root, F.lit(0)).otherwise(F.col("top")[x]).alias(f"t{x}") for x in ("a", "b")]).drop("top")


def _ends(rows: DataFrame) -> DataFrame:
    """(a, b, conv_id) to (a, b, ends_sha256): SHA-256 of the ids of each (a, b) in order, with commas between.

    Ids are put together where a range of them lies; only of names at the edge of a range, or with many ids, do pieces of
    text move once more, and one task digests them as they come.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, key, texts, size, seq = TaskContext.get().partitionId(), True, None, [], 0, 0

        def piece(text: str | None, digest: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((key[0], pa.int64()), (key[1], pa.int64()), (part, pa.int32()), (seq, pa.int64()), (text, pa.string()), (digest, pa.string()))], ["a", "b", "part", "seq", "text", "digest"])

        for batch in batches:
            for a, b, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (a, b):
                    if key is not None:
                        text = ",".join(texts)
                        yield piece(text, None) if first or seq else piece(None, hashlib.sha256(text.encode()).hexdigest())
                        first = False
                    key, texts, size, seq = (a, b), [], 0, 0
                texts.append(str(conv))
                size += len(texts[-1]) + 1
                if size > _CHUNK:
                    yield piece(",".join(texts), None)
                    texts, size, seq = [], 0, seq + 1
        if key is not None:
            yield piece(",".join(texts), None)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["a", "b", "ends_sha256"])

        for batch in batches:
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (a, b):
                    if key is not None:
                        yield done()
                    key, state, begun = (a, b), hashlib.sha256(), False
                if text:
                    state.update(f",{text}".encode() if begun else text.encode())
                    begun = True
        if key is not None:
            yield done()

    ranged = rows.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    pieces = written(ranged.mapInArrow(joined, "a long, b long, part int, seq long, text string, digest string"), "trie-ends")
    open_ = pieces.where("digest is null").repartition("a", "b").sortWithinPartitions("a", "b", "part", "seq")
    whole = pieces.where("digest is not null").select("a", "b", F.col("digest").alias("ends_sha256"))
    return whole.unionByName(open_.select("a", "b", "text").mapInArrow(digested, "a long, b long, ends_sha256 string"))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, queue_limit: int = QUEUE) -> DataFrame:
    """One row per node of the tree of all rebuilt conversations' beginnings, the root (depth 0) among them: conv_id
    (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes
    in its subtree), saved_tokens (of its subtree: (members - 1) times code points of a node's last text), ends_sha256.

    Turns are named by what leads up to them, members are counted by groups, and the subtree totals go up by time-forward
    processing: a shard's nodes are sorted by falling depth and each sends its totals to its parent through a priority
    queue that spills; then the totals of shard tops go to the shards above, level by level of shards, up to the root.

    Turns are ordered by turn (null first), then role, then SHA-256 of role and text; null role or text is empty; repeated rows
    are turns like any other. Rows without conv_id take no part. Negative ids belong to the hundred below them. A conversation
    may be rebuilt to no turn at all and ends at the root. An empty table gives no row. Other columns are left out.
    """
    turns = written(numbered_turns(conversations), "trie-turns")
    rows, convs = rebuilt_turns(turns)
    convs = written(convs, "trie-convs")
    path = written(paths(rows), "trie-paths")
    nodes = path.groupBy("a", "b").agg(
        F.any_value("pa").alias("pa"), F.any_value("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.any_value("chars").alias("chars"),
        F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("ends"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("ends"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    root = root.select("*", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"))
    nodes = written(_shards(nodes.unionByName(root), path, shard_turns), "trie-nodes")
    done = []
    kinds = "a long, b long, pa long, pb long, ta long, tb long, conv_id long, depth long, n_convs long, ends long, n_children long, n_leaves long, saved_tokens long"
    for level in sorted(r["level"] for r in nodes.select("level").distinct().collect()):  # a handful: each holds WIDER times the last
        own = nodes.where(F.col("level") == level)
        sums = {"in_children": F.lit(0).cast("long"), "in_leaves": F.lit(0).cast("long"), "in_saved": F.lit(0).cast("long")}
        if done:
            below = [d.where("a = ta and b = tb") for d in done]
            told = below[0]
            for d in below[1:]:
                told = told.unionByName(d)
            told = told.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("m_children"), F.sum("n_leaves").alias("m_leaves"), F.sum("saved_tokens").alias("m_saved"))
            own = own.join(told, ["a", "b"], "left")
            sums = {f"in_{c}": F.coalesce(f"m_{c}", F.lit(0)) for c in ("children", "leaves", "saved")}
        own = own.select("a", "b", "pa", "pb", "ta", "tb", "conv_id", "depth", "n_convs", "ends", "chars", *[v.alias(k) for k, v in sums.items()])
        own = own.repartition("ta", "tb").sortWithinPartitions("ta", "tb", F.desc("depth"), "a", "b")
        done.append(written(own.mapInArrow(_upwards(queue_limit), kinds), "trie-totals"))
    if not done:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    at_end = path.where("depth = length").select("a", "b", "conv_id")
    at_root = convs.where("length = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    ends = _ends(at_end.unionByName(at_root))
    above = every.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(above, ["pa", "pb"], "left").join(ends, ["a", "b"], "left")
    nobody: Column = F.lit(hashlib.sha256(b"").hexdigest())
    out = written(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256")), "trie")
    for table in (turns, convs, path, nodes, *done):
        release(table)
    return out
