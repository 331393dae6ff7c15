"""Byte-level BPE by a rank queue: buckets per merge rank under a hierarchical bitmap."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from shardwise.llm.pieces import Decoder, Remembering, worker_store
from shardwise.llm.store import documents

BATCH_BYTES = 1 << 20
#: Bytes of texts whose new words are merged together.
TEXT_BYTES = 4 << 20
#: Parts, and as many words, that a worker remembers before it forgets all: bounds its memory, never its results.
REMEMBERED = 1_000_000
#: Bytes of words merged at a time.
MERGED_BYTES = 1 << 20
#: Positions of a rank from which on they are merged as arrays.
MANY = 32


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by merge rank. Three levels of 64-bit words mark the ranks that hold any; the lowest is found by
    the lowest set bit of each level. Entries are not removed when a merge makes them stale; whoever takes them checks."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaf, self.middle, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0

    def fill(self, rank: int, positions: list[int]) -> None:
        """Positions of a rank that holds none."""
        self.buckets[rank] = positions
        self.leaf[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def lowest(self) -> int:
        """The lowest rank that holds positions, -1 if none does."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        a = a << 6 | (word & -word).bit_length() - 1
        word = self.leaf[a]
        return a << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The positions of a rank, leftmost first; it holds none then."""
        self.leaf[rank >> 6] &= ~(1 << (rank & 63))
        if not self.leaf[rank >> 6]:
            self.middle[rank >> 12] &= ~(1 << ((rank >> 6) & 63))
            if not self.middle[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        return sorted(self.buckets.pop(rank))


class Pairs:
    """All pairs of tokens that make a token: by both, and as sorted arrays by the token made, the left and the right one."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        a, b, r = (np.array(x, np.int64) for x in (left, right, made))
        self.rank = dict(zip((a << 24 | b).tolist(), made, strict=True))
        bounds = np.arange(max(ranks.values()) + 2)

        def by(one: np.ndarray, other: np.ndarray, value: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
            order = np.lexsort((other, one))
            return np.searchsorted(one[order], bounds).tolist(), other[order].astype(np.int32), value[order]

        self.of_left, self.of_right, self.of_made = by(a, b, r), by(b, a, r), by(r, a, b)

    @staticmethod
    def find(table: tuple[list[int], np.ndarray, np.ndarray], token: int, others: np.ndarray) -> np.ndarray:
        """The value a table has for `token` with each of the others, -1 where it has none."""
        begin, end = table[0][token : token + 2]
        if begin == end:
            return np.full(len(others), -1)
        there = table[1][begin:end]
        at = np.minimum(np.searchsorted(there, others), end - begin - 1)
        return np.where(there[at] == others, table[2][begin:end][at], -1)


class Merger:
    """Merges many pre-tokens at once: their bytes lie end to end, linked inside each pre-token only.

    A rank's positions are taken leftmost first and pre-tokens never touch each other, so each is merged just
    as if it were alone, and the queue's cost is shared. A rank with MANY positions is merged by array operations.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.queue = RankQueue(max(ranks.values()))
        self.pairs = Pairs(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        whole = list(map(self.ranks.get, words))
        open_words = [w for w, r in zip(words, whole, strict=True) if r is None]
        ends = np.cumsum([len(w) for w in open_words])
        cuts = [0, *np.unique(np.searchsorted(ends, np.arange(MERGED_BYTES, ends[-1], MERGED_BYTES)) + 1).tolist(), len(ends)] if open_words else []
        merged = chain.from_iterable(self._merge(open_words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j)
        return [r.to_bytes(4, "little") if r is not None else next(merged) for r in whole]

    def _first(self, text: np.ndarray, after: np.ndarray) -> None:
        """All neighbouring bytes that merge go into the queue, leftmost first within a rank."""
        if text.size < 2:
            return
        rank = self.two[text[:-1].astype(np.int64) << 8 | text[1:]]
        at = np.flatnonzero((rank >= 0) & (after[:-1] >= 0))
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, begins = np.unique(rank[at], return_index=True)
        for r, begin, end in zip(ranks.tolist(), begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
            self.queue.fill(r, at[begin:end].tolist())

    def _together(self, rank: int, taken: list[int], token: np.ndarray, after: np.ndarray, before: np.ndarray) -> bool:
        """Merge all positions of a rank at once; False, and nothing is done, if one of them makes a pair of lower rank."""
        p = np.array(taken, np.int32)
        p = p[np.append(True, p[1:] != p[:-1])]
        p = p[(token[p] >= 0) & (after[p] >= 0)]
        q = after[p]
        fresh = Pairs.find(self.pairs.of_made, rank, token[p]) == token[q]
        p, q = p[fresh], q[fresh]
        if not len(p):
            return True
        touch = q[:-1] == p[1:]
        if touch.any():  # each second one of those that overlap is stale once the one before is merged
            i = np.arange(len(p))
            every = (i - np.maximum.accumulate(np.where(np.append(True, ~touch), i, 0))) % 2 == 0
            p, q = p[every], q[every]
        right, left = after[q], before[p]
        beside = np.append(False, right[:-1] == p[1:])  # the one before ends here
        left[beside] = p[np.flatnonzero(beside) - 1]
        has_right, has_left = right >= 0, left >= 0
        r, rp, lq = right[has_right], p[has_right], left[has_left]
        find, pairs = Pairs.find, self.pairs
        # As if one by one: what stands to the right is not merged yet, what stands to the left is.
        merged_left = np.where(beside, rank, token[left])[has_left]
        made_left = find(pairs.of_right, rank, merged_left)
        made_right = find(pairs.of_left, rank, token[r])
        if ((made_left >= 0) & (made_left < rank)).any() or ((made_right >= 0) & (made_right < rank)).any():
            return False
        token[p], token[q] = rank, -1
        after[p], before[r] = right, rp
        made, at = np.concatenate([made_left, made_right]), np.concatenate([lq, rp])
        some = made >= 0
        made, at = made[some], at[some]
        if len(made):
            order = np.argsort(made, kind="stable")
            made, at = made[order], at[order].tolist()
            begins = np.flatnonzero(np.append(True, made[1:] != made[:-1]))
            buckets = self.queue.buckets
            for x, begin, end in zip(made[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
                if x in buckets:
                    buckets[x] += at[begin:end]
                else:
                    self.queue.fill(x, at[begin:end])
        return True

    def _merge(self, words: list[bytes]) -> list[bytes]:
        queue, pair = self.queue, self.pairs.rank.get
        buckets, fill, lowest = queue.buckets, queue.fill, queue.lowest
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        afters = np.arange(1, text.size + 1, dtype=np.int32)
        afters[ends[sizes > 0] - 1] = -1
        befores = np.arange(-1, text.size - 1, dtype=np.int32)
        befores[starts[sizes > 0]] = -1
        tokens = self.single[text]
        self._first(text, afters)
        token, after, before = memoryview(tokens), memoryview(afters), memoryview(befores)  # one by one, faster than arrays
        while (rank := lowest()) >= 0:
            # A merge makes no pair of its own rank, so a rank is taken whole, in order.
            taken, lower = queue.take(rank), False
            if len(taken) >= MANY and self._together(rank, taken, tokens, afters, befores):
                continue
            for i, p in enumerate(taken):
                a, q = token[p], after[p]
                if a < 0 or q < 0 or pair(a << 24 | token[q], -1) != rank:
                    continue  # stale
                token[p], token[q] = rank, -1
                right = after[p] = after[q]
                if right >= 0:
                    before[right] = p
                    r = pair(rank << 24 | token[right], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(p)
                        else:
                            fill(r, [p])
                            lower |= r < rank
                left = before[p]
                if left >= 0:
                    r = pair(token[left] << 24 | rank, -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(left)
                        else:
                            fill(r, [left])
                            lower |= r < rank
                if lower:  # a longer token may have a lower rank: that one is next
                    if rest := taken[i + 1 :]:
                        fill(rank, rest)
                    break
        at = np.flatnonzero(tokens >= 0)
        ids, cuts = tokens[at].astype("<u4").tobytes(), (4 * np.searchsorted(at, np.concatenate([starts, ends[-1:]]))).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


class Codec:
    """Texts to ids and back, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger, self.pattern = Merger(ranks), regex.compile(pattern)
        self.memory = Remembering(self._parts, REMEMBERED, TEXT_BYTES)
        self.words: dict[str, bytes] = {}
        self.decode = Decoder(self.merger.tokens).decode

    def _parts(self, parts: list[str]) -> list[bytes]:
        known, split = self.words, list(map(self.pattern.findall, parts))
        new = list(set().union(*split) - known.keys())
        known.update(zip(new, self.merger.encode(list(map(str.encode, new))), strict=True))
        out = [known[s[0]] if len(s) == 1 else b"".join(map(known.__getitem__, s)) for s in split]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memory.texts(texts)


def by_bytes(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow string array of about `limit` bytes, found without making Python strings."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    Texts are split by `pattern`, each match merged separately by the ranks of the file at `ranks_path` (which
    every executor must be able to open), without special tokens. No exchange: a row stays where it is read.
    Null text counts as empty: no ids. Null and repeated ids are rows like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_store(f"bpe:{ranks_path}:{pattern}", lambda: Codec(read_ranks(ranks_path), pattern))
        for batch in batches:
            for begin, end in by_bytes(batch.column(1), TEXT_BYTES):
                part = batch.slice(begin, end - begin)
                ids = codec.encode(part.column(1).to_pylist())
                back = [codec.decode(i) if decode else None for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
