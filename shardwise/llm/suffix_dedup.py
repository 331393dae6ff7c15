"""Repeated byte strings across documents: suffix sorting by bucket-pointer refinement."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from shardwise.llm.blocks import BUCKET_BYTES, Block, ask, blocks, bucket_slices, carried_rows, mix, pack, reply_list, unpack
from shardwise.llm.store import giving_back, written

LENGTH = 50
#: Bytes of the strings whose smallest hash names a window: every window of LENGTH bytes holds LENGTH - ANCHOR + 1.
ANCHOR = 16
#: Windows in one fragment at most; longer runs are cut, which changes nothing but their packaging.
RUN = 64
GRAM = 8
#: Suffixes that are sorted at a time.
SLICE_BYTES = 1 << 18
_STEP = 1 << 15
_SPREAD = np.uint64(0x2545F4914F6CDD1D)


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of `length` bytes the smallest hash of its ANCHOR-byte strings: equal windows, equal keys."""
    n = len(data) - length + 1
    out = np.empty(max(n, 0), np.uint64)
    wide = length - ANCHOR + 1
    for at in range(0, max(n, 0), _STEP):
        h = data[at : min(at + _STEP, n) + length - 1].astype(np.uint64) + np.uint64(1)
        size, base = 1, np.uint64(0x100000001B3)
        with np.errstate(over="ignore"):
            while size < ANCHOR:
                h = h[:-size] * base + h[size:]
                size, base = 2 * size, base * base
            h = mix(h)
        size = 1
        while 2 * size <= wide:
            h, size = np.minimum(h[:-size], h[size:]), 2 * size
        if size < wide:
            h = np.minimum(h[: len(h) - (wide - size)], h[wide - size :])
        out[at : at + len(h)] = mix(h ^ _SPREAD)  # smallest hashes are small; names are spread evenly again
    return out


def runs(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows inside documents, as runs of neighbours with one key: first window, windows, key, document."""
    keys = window_keys(block.data, length)
    if not len(keys):
        none = np.empty(0, np.int64)
        return none, none, keys, none
    doc = block.document_of()
    own, last = doc[: len(keys)], doc[length - 1 :]
    inside = own == last
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(keys)))
    ok = inside[at]
    at, sizes = at[ok], sizes[ok]
    pieces = -(-sizes // RUN)
    first = np.repeat(at, pieces)
    step = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first + step * RUN
    return begin, np.minimum(np.repeat(at + sizes, pieces) - begin, RUN), keys[begin], own[begin].astype(np.int64)


def _unique_keys(block: Block, found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block, the place of each run's key among them, and whether documents of several ids hold it."""
    _, _, keys, doc = found
    distinct, place = np.unique(keys, return_inverse=True)
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, place, block.ids[doc])
    np.maximum.at(high, place, block.ids[doc])
    return distinct, place, low != high


def _ask_keys(length: int, buckets: int):
    def question(payload: bytes, _: list[bytes]) -> Iterator[tuple[int, bytes]]:
        block = Block.load(payload)
        keys, _, several = _unique_keys(block, runs(block, length))
        # 40 bits below the bucket's; two keys that agree in them only bring a candidate more.
        small = np.ascontiguousarray((keys << np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, 2:7]) if len(keys) else np.empty((0, 5), np.uint8)
        for bucket, a, b in bucket_slices(keys, buckets):
            yield bucket, struct.pack("<q", b - a) + np.packbits(several[a:b]).tobytes() + small[a:b].tobytes()

    return question


def _shared(asked: list[bytes]) -> list[bytes]:
    """Of each block's keys, the bits of those that a document of another id may hold too."""
    sizes, keys, several = [], [], []
    for blob in asked:
        (n,) = struct.unpack_from("<q", blob)
        bits = -(-n // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 8 + bits).reshape(n, 5)
        sizes.append(n)
        keys.append(wide.view(np.uint64).ravel())
        several.append(np.unpackbits(np.frombuffer(blob, np.uint8, bits, 8), count=n).astype(bool))
    _, place, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    hit = counts > 1
    hit |= np.bincount(place, weights=np.concatenate(several), minlength=len(counts)) > 0
    flags = hit[place]
    return [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]


class Fragments:
    """The distinct fragments of a block whose keys are shared, sorted by key: what it asks about and is told of."""

    def __init__(self, block: Block, replies: list[bytes], length: int, asked_buckets: int):
        self.block = block
        self.found = runs(block, length)
        begin, windows, keys, doc = self.found
        distinct, place, _ = _unique_keys(block, self.found)
        flags = [np.unpackbits(np.frombuffer(r, np.uint8), count=b - a) for r, (_, a, b) in zip(replies, bucket_slices(distinct, asked_buckets), strict=True)]
        shared = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        self.hits = np.flatnonzero(shared[place]) if len(distinct) else np.empty(0, np.int64)
        begin, windows, keys, doc = begin[self.hits], windows[self.hits], keys[self.hits], doc[self.hits]
        width = RUN + length - 1
        rows = np.zeros((len(begin), width + 9), np.uint8)
        # Big-endian key first: rows sort by key; then the size, so that equal rows are equal fragments.
        rows[:, :8] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 8] = windows
        step = _STEP // 16
        for a in range(0, len(begin), step):
            at = begin[a : a + step, None] + np.arange(width)
            there = np.arange(width) < (windows[a : a + step, None] + length - 1)
            rows[a : a + step, 9:] = np.where(there, block.data[np.minimum(at, len(block.data) - 1)], 0)
        text = rows.view(f"V{width + 9}").ravel()
        order = np.argsort(rows.view(f"S{width + 9}").ravel(), kind="stable") if len(rows) else np.empty(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = text[order][1:] != text[order][:-1]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        head = order[new]
        self.keys, self.windows, self.rows = keys[head], windows[head], rows[head, 9:]
        self.least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.place, block.ids[doc])


def _ask_fragments(length: int, asked: int, buckets: int):
    def question(payload: bytes, replies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        f = Fragments(Block.load(payload), replies, length, asked)
        for bucket, a, b in bucket_slices(f.keys, buckets):
            there = np.arange(f.rows.shape[1]) < (f.windows[a:b, None] + length - 1)
            yield bucket, pack(struct.pack("<q", b - a) + f.keys[a:b].tobytes() + f.least[a:b].tobytes() + f.windows[a:b].astype(np.uint8).tobytes() + f.rows[a:b][there].tobytes())

    return question


def refine(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of many strings sorted to `depth` bytes: positions with so many bytes left, and their bucket pointers.

    Positions start in buckets of equal GRAM bytes; a pointer is the bucket's first place in the order. A bucket is
    refined by sorting its members on the pointers found `have` bytes on, which already are as deep as `have`; the
    pointers so updated are what the next step sorts on, so the depth doubles. Buckets of one are left alone.
    """
    size = ends - starts
    rest = np.repeat(ends, size) - np.arange(len(data))
    have = min(GRAM, depth)
    pointer = np.full(len(data), -1, np.int64)
    live = np.flatnonzero(rest >= have)
    gram = np.zeros(len(live), np.uint64)
    for i in range(have):
        gram = gram << np.uint64(8) | data[live + i].astype(np.uint64)
    order = np.argsort(gram)
    new = np.ones(len(order), bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    pointer[live[order]] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    while have < depth:
        on = min(have, depth - have)
        live = live[rest[live] >= have + on]
        members = np.bincount(pointer[live], minlength=len(data) + 1)
        active = live[members[pointer[live]] > 1]
        own, later = pointer[active], pointer[active + on]
        # Pointers are places in `data`, far below 2**31: both fit one number, which is sorted faster than two.
        order = np.argsort(own << np.int64(32) | later)
        own, later = own[order], later[order]
        bucket = np.ones(len(order), bool)
        bucket[1:] = own[1:] != own[:-1]
        sub = bucket.copy()
        sub[1:] |= later[1:] != later[:-1]
        at = np.arange(len(order))
        inside = np.maximum.accumulate(np.where(sub, at, 0)) - np.maximum.accumulate(np.where(bucket, at, 0))
        pointer[active[order]] = own + inside
        have += on
    return live, pointer[live]


def _slices(keys: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Sorted keys in slices of about SLICE_BYTES; equal keys stay together, for only they can hold equal windows."""
    begin = 0
    firsts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)).tolist() if len(keys) else []
    total = np.concatenate([[0], np.cumsum(sizes)])
    for b in firsts[1:]:
        if total[b] - total[begin] >= SLICE_BYTES:
            yield slice(begin, b)
            begin = b
    if begin < len(keys):
        yield slice(begin, len(keys))


def distinct_texts(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings between neighbouring bounds: the first of each distinct one, and for every string its place among these."""
    seen: dict[bytes, int] = {}
    at = bounds.tolist()
    place = np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip(at, at[1:], strict=False)), np.int64, len(at) - 1)
    _, first = np.unique(place, return_index=True)
    return first, place


def _holders(length: int):
    def answer(asked: list[bytes]) -> list[bytes]:
        """For each fragment the smallest id that holds each of its windows, as runs (windows, id)."""
        sizes, keys, least, windows, texts = [], [], [], [], []
        for blob in asked:
            raw = unpack(blob)
            (n,) = struct.unpack_from("<q", raw)
            sizes.append(n)
            keys.append(np.frombuffer(raw, np.uint64, n, 8))
            least.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
            windows.append(np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(np.int64))
            texts.append(np.frombuffer(raw, np.uint8, -1, 8 + 17 * n))
        key, low, count, data = map(np.concatenate, (keys, least, windows, texts))
        # Blocks that hold copies send equal fragments: one of each is sorted, for the smallest of their ids.
        head, same = distinct_texts(data.tobytes(), np.concatenate([[0], np.cumsum(count + length - 1)]))
        all_count, all_starts = count, np.cumsum(count + length - 1) - (count + length - 1)
        least_of = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(least_of, same, low)
        key, low, count, starts = key[head], least_of, count[head], all_starts[head]
        spans = count + length - 1
        holder = np.repeat(low, count)  # of each window, so far
        first = np.cumsum(count) - count
        # A key that one fragment only has needs no sorting: nobody else holds its windows.
        _, place, members = np.unique(key, return_inverse=True, return_counts=True)
        many = np.flatnonzero(members[place] > 1)
        many = many[np.argsort(place[many], kind="stable")]
        for part in _slices(place[many], spans[many]):
            own = many[part]
            own_ends = np.cumsum(spans[own])
            own_starts = own_ends - spans[own]
            at = np.repeat(starts[own] - own_starts, spans[own]) + np.arange(own_ends[-1])
            where, bucket = refine(data[at], own_starts, own_ends, length)
            fragment = np.searchsorted(own_ends, where, side="right")
            best = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, bucket, low[own][fragment])
            holder[first[own][fragment] + where - own_starts[fragment]] = best[bucket]
        step = np.arange(all_count.sum()) - np.repeat(np.cumsum(all_count) - all_count, all_count)
        holder = holder[np.repeat(first[same], all_count) + step]
        fragment = np.repeat(np.arange(len(same)), all_count)
        new = np.ones(len(holder), bool)
        new[1:] = (holder[1:] != holder[:-1]) | (fragment[1:] != fragment[:-1])
        begin = np.flatnonzero(new)
        length_of = np.diff(np.append(begin, len(holder)))
        per = np.bincount(fragment[begin], minlength=len(same))
        cuts = np.cumsum(per)
        out, a, at = [], 0, 0
        for n in sizes:
            b = int(cuts[at + n - 1]) if n else a
            out.append(pack(struct.pack("<qq", n, b - a) + per[at : at + n].astype(np.uint8).tobytes() + length_of[a:b].astype(np.uint8).tobytes() + holder[begin[a:b]].tobytes()))
            a, at = b, at + n
        return out

    return answer


def _covered(payload: bytes, keys: list[bytes], holders: list[bytes], length: int, asked: int) -> tuple[Block, np.ndarray]:
    """The bytes of a block that a string held by a smaller id covers."""
    block = Block.load(payload)
    f = Fragments(block, keys, length, asked)
    marks = np.zeros(len(block.data) + 1, np.int32)
    if len(f.hits):
        per, span, ids = [], [], []
        for r in holders:
            raw = unpack(r)
            n, m = struct.unpack_from("<qq", raw)
            per.append(np.frombuffer(raw, np.uint8, n, 16))
            span.append(np.frombuffer(raw, np.uint8, m, 16 + n))
            ids.append(np.frombuffer(raw, np.int64, m, 16 + n + m))
        per, span, ids = np.concatenate(per).astype(np.int64), np.concatenate(span).astype(np.int64), np.concatenate(ids)
        window_ids = np.repeat(ids, span)
        first = np.cumsum(f.windows) - f.windows
        begin, windows, _, doc = (x[f.hits] for x in f.found)
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        smallest = window_ids[np.repeat(first[f.place], windows) + step]
        at = (np.repeat(begin, windows) + step)[smallest < np.repeat(block.ids[doc], windows)]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
    return block, np.cumsum(marks[:-1]) > 0


def whole_characters(data: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Covered bytes without those of characters that are covered in part."""
    if not len(data):
        return covered
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    starts = np.union1d([0], starts)
    return np.repeat(np.minimum.reduceat(covered, starts), np.diff(np.append(starts, len(data))))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False, carry: list[str] | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary; or text, see below).

    A byte goes if a string of `length` bytes over it also starts in a document of smaller id; strings are judged
    on the input and never cross documents. Only suffixes that can match are sorted: windows are named by the smallest
    hash of the ANCHOR-byte strings in them, blocks ask which names others hold, and neighbouring windows of one
    shared name travel as one fragment, once per block, to the name's bucket. There bucket-pointer refinement
    sorts their suffixes to `length` bytes, and each block learns the smallest id holding each window.

    With `as_text`, kept holds text: a character stays whole unless all its bytes go. The counts are of bytes
    covered in either case. The columns of `docs` named by `carry` come along in a struct, row. Null text counts as empty. Null ids count as larger than any other and give nothing
    to each other, just as rows that share an id do. Texts shorter than `length` stay whole.
    """
    if length <= ANCHOR or length + RUN > 250:
        raise ValueError("length must be between 17 and 186")
    base, total = blocks(docs, "suffix-blocks", id_col, text_col, carry=carry)
    buckets = int(total // bucket_bytes) + 1
    bits = written(ask(base, _ask_keys(length, buckets), _shared), "suffix-bits")
    told = base.join(bits, "block", "left").select("block", "payload", "replies")
    holders = ask(told, _ask_fragments(length, buckets, buckets), _holders(length)).withColumnRenamed("replies", "holders")
    final = base.join(bits, "block", "left").join(holders, "block", "left").select("payload", "replies", "holders", *["carried"] * bool(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload, keys, holders = (batch.column(c)[i].as_py() for c in range(3))
                block, covered = _covered(payload, reply_list(keys), reply_list(holders), length, buckets)
                gone = np.concatenate([[0], np.cumsum(covered)])
                rise = covered.copy()
                rise[1:] &= ~covered[:-1]
                inner = block.starts[block.starts < len(covered)]
                rise[inner] = covered[inner]
                spans = np.concatenate([[0], np.cumsum(rise)])
                left = ~(whole_characters(block.data, covered) if as_text else covered)
                kept = [block.data[a:b][left[a:b]].tobytes() for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True)]
                own = [carried_rows(batch.column(3)[i].as_py())] if carry else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.ids, pa.int64(), mask=block.null),
                        pa.array(block.ends - block.starts, pa.int64()),
                        pa.array(gone[block.ends] - gone[block.starts], pa.int64()),
                        pa.array(spans[block.ends] - spans[block.starts], pa.int64()),
                        pa.array([k.decode() for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
                        *own,
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "row"][: 5 + len(own)],
                )

    kinds = StructType.fromDDL(f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    if carry:
        kinds = kinds.add("row", StructType([docs.schema[c] for c in carry]), False)
    return final.mapInArrow(giving_back(run), kinds)
