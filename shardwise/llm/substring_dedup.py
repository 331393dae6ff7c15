"""Repeated runs of words across documents: winnowed anchors are joined, matches extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.blocks import Block, blocks, mix
from shardwise.llm.store import release, written

LENGTH = 20
#: Words of an anchor: every window of LENGTH words holds LENGTH - SEED + 1 such strings, the smallest hash is its anchor.
SEED = 8
#: Occurrences of an anchor from which on its windows travel as seeds of full length, so that no group is larger.
HOT = 2_000
#: Fragments that are extended at a time.
TOGETHER = 40_000
#: Bytes of a word from which on its id is a digest.
LONG = 64
#: An odd multiplier and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_bounds(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each word; a document's end ends its last word. bytes.split() finds the same words."""
    word = ~_SPACE[block.data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    some = block.ends > block.starts
    first, last = block.starts[some], block.ends[some] - 1
    begins[first], ends[last] = word[first], word[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit ids that name the words: mixed from the length and eight bytes at a time, of long words a digest."""
    size = end - begin
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    ids = mix(size.astype(np.uint64))
    at = np.flatnonzero(size <= LONG)
    for step in range(0, LONG, 8):
        at = at[size[at] > step]
        ids[at] = mix(ids[at] ^ (eight[begin[at] + step] & _FIRST[np.minimum(size[at] - step, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        ids[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return ids


class Windows:
    """The words of a block's documents and its runs: neighbouring windows that have one anchor, at one place.

    A window's anchor is its SEED-word string of smallest hash, the last of equal ones: it depends on the words of the
    window alone, so equal windows have equal anchors at equal distance from their start.
    """

    def __init__(self, payload: bytes, length: int, seed: int):
        self.block, self.length, self.seed = Block.load(payload), length, seed
        self.start, self.stop = word_bounds(self.block)
        self.first = np.searchsorted(self.start, self.block.starts)
        self.counts = np.searchsorted(self.start, self.block.ends) - self.first
        self.ids = word_ids(self.block.data, self.start, self.stop)
        self._runs(self.ids)

    def _runs(self, ids: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        n, wide = len(ids) - self.length + 1, self.length - self.seed + 1
        if n <= 0:
            self.begin = self.many = self.place = self.doc = np.empty(0, np.int64)
            self.anchor = np.empty(0, np.int64)
            return
        h, size, base = ids, 1, np.uint64(0x100000001B3)
        with np.errstate(over="ignore"):
            while 2 * size <= self.seed:
                h, size, base = h[:-size] * base + h[size:], 2 * size, base * base
            if size < self.seed:  # overlapping halves name a string as well
                rest = self.seed - size
                h = h[:-rest] * base + mix(h[rest:])
            h = mix(h)
        at, size = np.arange(len(h), dtype=np.int32), 1
        while size < wide:
            step = min(size, wide - size)
            later = h[step:] <= h[:-step]
            h, at = np.where(later, h[step:], h[:-step]), np.where(later, at[step:], at[:-step])
            size += step
        inside = doc[:n] == doc[self.length - 1 :]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:n] != doc[: n - 1])
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, n))
        ok = inside[begin]
        self.begin, self.many = begin[ok], many[ok]
        self.place, self.anchor, self.doc = at[self.begin].astype(np.int64), h[self.begin].view(np.int64), doc[self.begin].astype(np.int64)

    def fragments(self, shared: np.ndarray, hot: np.ndarray) -> Fragments:
        """What this block asks about: of each run whose anchor is shared, all that its windows cover.

        Of an anchor in `hot` each window is a fragment of its own, whose key names all its words.
        """
        is_hot = np.isin(self.anchor, hot)
        run = np.flatnonzero(is_hot | np.isin(self.anchor, shared))
        pieces = np.where(is_hot[run], self.many[run], 1)
        run = np.repeat(run, pieces)
        step = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, many = self.begin[run] + step, np.where(is_hot[run], 1, self.many[run])
        end = begin + many + self.length - 1
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.append(np.uint64(1), np.full(len(self.ids), _BASE)))
            back = np.cumprod(np.append(np.uint64(1), np.full(len(self.ids), _INVERSE)))
            total = np.append(np.uint64(0), np.cumsum(self.ids * powers[:-1]))
            left = self.place[run] - begin
            name = mix((total[end] - total[begin]) * back[begin] + mix((left * 1_000 + many).astype(np.uint64)))
        name = mix(name ^ self.anchor[run].view(np.uint64)).view(np.int64)
        doc = self.doc[run]
        rank = _ranks(self.block.null[doc], self.block.ids[doc], self.place[run] - self.first[doc])
        slots, slot = np.unique(name, return_inverse=True)
        order = np.lexsort((rank, slot))
        head = order[np.append(True, slot[order][1:] != slot[order][:-1])] if len(order) else order
        return Fragments(self, begin, end, many, left, doc, self.place[run], rank, slot, head, is_hot[run], np.where(is_hot[run], name, self.anchor[run]))


@dataclass
class Fragments:
    """Occurrences of fragments in a block; `slot` numbers the distinct ones and `head` is the earliest occurrence of each."""

    windows: Windows
    begin: np.ndarray
    end: np.ndarray
    many: np.ndarray
    left: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    rank: np.ndarray
    slot: np.ndarray
    head: np.ndarray
    hot: np.ndarray
    key: np.ndarray

    def rows(self, number: int, step: int = 10_000) -> Iterator[pa.RecordBatch]:
        """Each distinct fragment once, with the place of its earliest occurrence."""
        w = self.windows
        data = w.block.data.tobytes()
        for at in range(0, len(self.head), step):
            h = self.head[at : at + step]
            doc = self.doc[h]
            texts = [b" ".join(data[a:b].split()) for a, b in zip(w.start[self.begin[h]].tolist(), w.stop[self.end[h] - 1].tolist(), strict=True)]
            columns = [(self.key[h], pa.int64()), (self.hot[h], pa.bool_()), (np.full(len(h), number), pa.int64()), (np.arange(at, at + len(h), dtype=np.int32), pa.int32()), (w.block.null[doc], pa.bool_())]
            columns += [(w.block.ids[doc], pa.int64()), (self.place[h] - w.first[doc], pa.int64()), (self.left[h].astype(np.int32), pa.int32()), (texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["key", "hot", "block", "slot", "none", "doc", "pos", "left", "text"])

    def covered(self, slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Words under a window that starts earlier: elsewhere, as the bits by slot say, or at the fragment's head."""
        earlier = np.zeros(len(self.head), np.int64)
        earlier[slots] = bits
        every = (np.int64(1) << self.many) - 1
        own = np.where(self.rank == self.rank[self.head][self.slot], earlier[self.slot], every) if len(self.slot) else every
        marks = np.zeros(len(self.windows.ids) + 1, np.int32)
        for i in range(int(self.many.max()) if len(self.many) else 0):
            at = self.begin[(own >> i) & 1 == 1] + i
            np.add.at(marks, at, 1)
            np.add.at(marks, at + self.windows.length, -1)
        return np.cumsum(marks[:-1]) > 0


def extend(anchors: np.ndarray, left: np.ndarray, texts: list[bytes], rank: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For each fragment the bits of its windows that a fragment of smaller rank has too.

    All fragments of an anchor are extended together, word by word: those that still agree to the left share a class,
    those that agree to the right another. A window with l words before the anchor is one that agrees l words to the
    left and the rest of its length to the right; the smallest rank among those that do holds it first.
    """
    bits = np.zeros(len(texts), np.int64)
    numbers: dict[bytes, int] = {}
    split = [t.split(b" ") for t in texts]
    size = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for s in split for w in s), np.int64, int(size.sum()))
    start = np.cumsum(size) - size + left
    stride = len(numbers) + 1

    def refined(classes: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        word = np.where(there, flat[np.minimum(np.maximum(at, 0), len(flat) - 1)] + 1, 0)
        return np.unique(classes * stride + word, return_inverse=True)[1]

    same = np.unique(anchors, return_inverse=True)[1]
    every = np.ones(len(texts), bool)
    for i in range(seed):
        same = refined(same, start + i, every)
    reach = length - seed
    to_left, to_right = [same], [same]
    for i in range(reach):
        to_left.append(refined(to_left[-1], start - 1 - i, left > i))
        to_right.append(refined(to_right[-1], start + seed + i, size - left - seed > i))
    most = left - (size - length)
    for before in range(reach + 1):
        rows = np.flatnonzero((most <= before) & (before <= left))
        pairs = to_left[before][rows] * (len(texts) + 1) + to_right[reach - before][rows]
        own = np.unique(pairs, return_inverse=True)[1]
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, own, rank[rows])
        bits[rows] |= (rank[rows] > least[own]).astype(np.int64) << (left[rows] - before)
    return bits


def _ranks(null: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    order = np.lexsort((pos, doc, null))
    a, b = order[1:], order[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(0, (null[a] != null[b]) | (doc[a] != doc[b]) | (pos[a] != pos[b])))[: len(order)]
    return rank


def _extended(length: int, seed: int, together: int):
    """Rows sorted by key and order to (block, slot, bits): anchors' groups whole, seeds of full length as they come."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        keys, null, doc, pos, left = (t.column(c).to_numpy() for c in ("key", "none", "doc", "pos", "left"))
        _, own, members = np.unique(keys, return_inverse=True, return_counts=True)
        many = np.flatnonzero(members[own] > 1)
        texts = t.column("text").take(pa.array(many)).to_pylist()
        bits = extend(keys[many], left[many].astype(np.int64), texts, _ranks(null[many], doc[many], pos[many]), length, seed) if len(many) else np.empty(0, np.int64)
        hit = many[bits != 0]
        return pa.RecordBatch.from_arrays([t.column(c).take(pa.array(hit)).combine_chunks() for c in ("block", "slot")] + [pa.array(bits[bits != 0], pa.int64())], ["block", "slot", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, key, least = 0, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            hot = batch.column(batch.schema.get_field_index("hot")).to_numpy(zero_copy_only=False)
            out = []
            for r in batch.filter(pa.array(hot)).to_pylist():
                if r["key"] != key:
                    key, least = r["key"], {}
                order = (r["none"], r["doc"], r["pos"])
                if order > least.setdefault(r["text"], order):  # rows come in order: the first has it first
                    out.append((r["block"], r["slot"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([s for _, s in out], pa.int32()), pa.array([1] * len(out), pa.int64())], ["block", "slot", "bits"])
            rest = batch.filter(pa.array(~hot))
            held.append(rest)
            size += rest.num_rows
            if size > together:
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield solve(t.slice(0, cut))
                    held, size = t.slice(cut).to_batches(), len(keys) - cut
        if size:
            yield solve(pa.Table.from_batches(held))

    return run


def _shared(limit: int):
    """Rows (anchor, block, n) sorted by anchor to (block, anchor, hot), of anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, waiting = None, 0, []

        def told(rows: list[int], hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([key] * len(rows), pa.int64()), pa.array([hot] * len(rows), pa.bool_())], ["block", "anchor", "hot"])

        done: list[tuple[int, int]] = []
        for batch in batches:
            for anchor, block, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if anchor != key:
                    if seen > 1 and waiting:
                        done += [(b, key) for b in waiting]
                    key, seen, waiting = anchor, 0, []
                seen += n
                waiting.append(block)
                if seen > limit:
                    yield told(waiting, True)
                    waiting = []
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([False] * len(done), pa.bool_())], ["block", "anchor", "hot"])
                done = []
        if seen > 1 and waiting:
            done += [(b, key) for b in waiting]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([False] * len(done), pa.bool_())], ["block", "anchor", "hot"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT, together: int = TOGETHER) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (word ranges [start, end) that go), kept (words joined by one space).

    Words are what stands between the six characters space and x09 to x0D. A word goes if a window of `length` words over
    it also starts earlier: in a document of smaller id, or further up in the same one. Windows are judged on the input.
    Texts are winnowed to anchors of `seed` words; anchors that occur once go no further. Blocks send the words around each
    shared anchor, once per block, to the anchor's group, where all are extended to both sides; repeats shorter than
    `length` are dropped there, and longer ones go on from anchor to anchor, so they are removed to their full extent.
    Anchors with more than `hot` occurrences are sent as whole windows instead, which need no group: the first in order wins.

    Null text has no words. Null ids come after all others. Rows that share an id, or have none, count as one document laid
    over itself: the occurrence that starts further up is the earlier one, and those at the same place give nothing to each
    other. Texts shorter than `length` words stay whole, white space becomes single spaces. Other columns are left out.
    """
    if not 0 < seed < length or length - seed > 62:
        raise ValueError("seed must be shorter than length, by 62 words at most")
    base, _ = blocks(docs, "substring-blocks", id_col, text_col)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, n = np.unique(Windows(payload.as_py(), length, seed).anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.full(len(own), number), pa.int64()), pa.array(n, pa.int64())], ["anchor", "block", "n"])

    every = base.select("block", "payload").mapInArrow(anchors, "anchor long, block long, n long")
    shared = every.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared(hot), "block long, anchor long, hot boolean")
    # A block's own anchors: bounded by the block.
    cold, warm = (F.collect_list(F.when(is_hot, F.col("anchor"))) for is_hot in (~F.col("hot"), F.col("hot")))
    seeds = written(shared.groupBy("block").agg(cold.alias("shared"), warm.alias("often")), "substring-seeds")
    told = base.join(seeds, "block").select("block", "payload", "shared", "often")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, payload = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                yield from Windows(payload, length, seed).fragments(*(batch.column(c)[i].values.to_numpy() for c in (2, 3))).rows(number)

    sent = told.mapInArrow(send, "key long, hot boolean, block long, slot int, none boolean, doc long, pos long, left int, text binary")
    grouped = sent.repartition("key").sortWithinPartitions("key", "hot", "none", "doc", "pos")
    found = grouped.mapInArrow(_extended(length, seed, together), "block long, slot int, bits long")
    replies = written(found.groupBy("block").agg(F.collect_list("slot").alias("slots"), F.collect_list("bits").alias("bits")), "substring-replies")
    final = base.join(seeds, "block", "left").join(replies, "block", "left").select("payload", "shared", "often", "slots", "bits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = Windows(batch.column(0)[i].as_py(), length, seed)
                shared, often, slots, bits = (np.array([] if (v := batch.column(c)[i].values) is None else v.to_numpy(), np.int64) for c in range(1, 5))
                gone = w.fragments(shared, often).covered(slots, bits)
                removed, spans, kept = [], [], []
                total, data = np.append(0, np.cumsum(gone)), w.block.data.tobytes()
                for a, n, begin, end in zip(w.first.tolist(), w.counts.tolist(), w.block.starts.tolist(), w.block.ends.tolist(), strict=True):
                    words = data[begin:end].split()
                    removed.append(int(total[a + n] - total[a]))
                    if not removed[-1]:
                        spans.append([])
                        kept.append(b" ".join(words).decode())
                        continue
                    own = gone[a : a + n]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist()
                    spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                    kept.append(b" ".join(compress(words, (~own).tolist())).decode())
                block = w.block
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64(), mask=block.null), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "spans", "kept"],
                )

    out = written(final.mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"), "substring-kept", "zstd")
    for table in (base, seeds, replies):
        release(table)
    return out
