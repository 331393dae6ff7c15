"""Blocks of whole documents, and questions a block asks about keys that other blocks may hold too."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.store import documents, give_back, giving_back, written

BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max


@dataclass
class Block:
    """Documents end to end: ids (NO_ID where null, and null), first and last byte of each, all bytes."""

    ids: np.ndarray
    null: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @classmethod
    def load(cls, payload: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        (n,) = struct.unpack_from("<q", raw)
        ids, sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
        null = np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(bool)
        ends = np.cumsum(sizes)
        return cls(ids, null, ends - sizes, ends, np.frombuffer(raw, np.uint8, -1, 8 + 17 * n))

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.ends - self.starts)


def pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes() if isinstance(data, np.ndarray) else data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def blocks(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """The documents as rows (block, n_bytes, payload) of about `size` bytes of text, written once; their bytes in all.

    A block is what one task holds at a time; a text longer than `size` is a block of its own. The columns named by
    `carry` go with it, in the order of its documents, as column carried (see carried_rows).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size_held = 0

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, texts = t.column(0).combine_chunks(), t.column(1).combine_chunks()
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            raw = struct.pack("<q", len(ids)) + pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False).tobytes() + sizes.tobytes() + null.tobytes()
            raw += b"".join(x.encode() for x in texts.to_pylist())
            arrays = [pa.array([number], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([pack(raw)], pa.binary())]
            if carry:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([t.schema.field(2)])) as stream:
                    stream.write_table(t.select([2]))
                arrays.append(pa.array([pack(sink.getvalue().to_pybytes())], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, ["block", "n_bytes", "payload", "carried"][: len(arrays)])

        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).tolist()
            begin = 0
            for i, n in enumerate(sizes):
                if size_held and size_held + n > size:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield made()
                    held, begin, size_held, number = [], i, 0, number + 1
                size_held += n
            if begin < len(sizes):
                held.append(batch.slice(begin))
        if held:
            yield made()

    rows = documents(docs, id_col, text_col)
    if carry:
        own = F.struct(*[F.col(c) for c in carry]).alias("row")
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), own)
    out = written(rows.mapInArrow(giving_back(run), "block long, n_bytes long, payload binary" + ", carried binary" * bool(carry)), name)
    return out, out.agg(F.sum("n_bytes")).first()[0] or 0


def carried_rows(carried: bytes) -> pa.Array:
    """What blocks() carried: a struct for each document."""
    return pa.ipc.open_stream(unpack(carried)).read_all().column(0).combine_chunks()


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key: ranges of equal width, so sorted keys have rising buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_slices(sorted_keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that sorted keys fall in."""
    own = buckets_of(sorted_keys, buckets)
    some, begins = np.unique(own, return_index=True)
    return list(zip(some.tolist(), begins.tolist(), [*begins[1:].tolist(), len(own)], strict=True))


def ask(asking: DataFrame, question: Callable[..., Iterable[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, replies) for each block that asked something; replies is an array of (bucket, reply).

    `asking` has block, payload and possibly replies to an earlier question. question(payload, earlier replies)
    gives (bucket, packed keys); answer(all packed keys of a bucket) gives a reply for each, in order. A key is in
    one bucket and at most once in a block, so a bucket does not grow with how often blocks repeat a key inside.
    """
    further = [c for c in asking.columns if c == "replies"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                earlier = reply_list(batch.column(2)[i].as_py()) if further else []
                rows = list(question(batch.column(1)[i].as_py(), earlier))
                if rows:
                    number = batch.column(0)[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block", "keys"])

    def reply(table: pa.Table) -> pa.Table:
        replies = answer(table.column("keys").to_pylist())
        give_back()
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "reply": pa.array(replies, pa.binary())})

    asked = asking.select("block", "payload", *further).mapInArrow(giving_back(put), "bucket long, block long, keys binary")
    answered = asked.groupBy("bucket").applyInArrow(reply, "bucket long, block long, reply binary")
    return answered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))


def reply_list(replies: list[dict] | None) -> list[bytes]:
    return [r["reply"] for r in replies or []]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys that spreads every bit over all."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h
