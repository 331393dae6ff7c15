"""Packing documents into token sequences: exact complements first, best fit for what is left."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwise.llm.bpe import by_bytes
from shardwise.llm.pieces import Remembering, forget_parts, worker_store
from shardwise.llm.store import documents, give_back, written

SEQUENCE_TOKENS = 2048
END_ID = 0
ROWS_PER_RANK_GROUP = 20_000


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabulary files write for the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level BPE file of the tokenizers library."""
    bytes_of = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return {i: bytes(map(bytes_of.__getitem__, t)) for t, i in tokens.items() if all(c in bytes_of for c in t)}


def encoder(vocabulary_path: str, pattern: str) -> Remembering:
    """Ids of a byte-level BPE file of the tokenizers library, as bytes; control strings are ordinary text.

    Where the file's merges are in the order of their ids, ids are ranks and the faster tiktoken gives the
    same ids; otherwise the tokenizers library encodes.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if order == sorted(order):
        import tiktoken

        bytes_of, special = byte_alphabet(), set(model["vocab"].values()) - set(order)
        ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in model["vocab"].items() if i not in special or len(t) == 1}
        encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return Remembering(lambda parts: [np.array(encode(p), "<u4").tobytes() for p in parts])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path)
    tokenizer.encode_special_tokens = True
    return Remembering(lambda parts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(parts, add_special_tokens=False)])


def document_encoder(vocabulary_path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Ids as the tokenizers library gives them with add_special_tokens=False: added tokens in a text have their own ids.

    The library looks for added tokens first and encodes what lies between as texts of their own; so does this,
    before any text is cut at spaces. Files whose added tokens take in their surroundings go to the library whole.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        file = json.load(f)
    added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in file.get("added_tokens", [])}
    if any(t.get(k) for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary_path)
        return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    memory = worker_store(f"pack:{vocabulary_path}:{pattern}", lambda: encoder(vocabulary_path, pattern))
    if not added:
        return memory.texts
    any_added = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

    def texts(texts: list[str]) -> list[bytes]:
        sections = [any_added.split(t) for t in texts]  # text, added token, text, ...
        plain = iter(memory.texts([s for own in sections for s in own[::2]]))
        return [b"".join(added[s] if i % 2 else next(plain) for i, s in enumerate(own)) for own in sections]

    return texts


def tokenized_pieces(docs: DataFrame, vocabulary_path: str, pattern: str, tokens: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each document's ids and the end id, cut only if longer than a sequence.

    Null and empty texts are the end id alone. Very long texts are encoded whole and give as many pieces as they need, the
    first of them shorter. Null ids, rows that share an id and repeated rows each have pieces of their own. An empty table
    gives none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_store(f"pack-documents:{vocabulary_path}:{pattern}", lambda: document_encoder(vocabulary_path, pattern))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for begin, stop in by_bytes(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at = [0, *range(n % tokens or tokens, n + 1, tokens)]
                    rows += [(doc, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])
        forget_parts()
        give_back()

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: np.ndarray, tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """How many pieces there are of each length, to fillings (lengths, how many sequences take it).

    For the longest piece left: a single length, a pair, a triple whose sum is exactly the gap, found in indexes
    of available lengths and pair sums and used as often as the counts allow; then the best-fitting lengths.
    Every step uses up a length or a gap, so the work depends on `tokens` only, not on the pieces.
    """
    left, out = counts.astype(np.int64).copy(), []

    def most(lengths: tuple[int, ...]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in lengths)

    def take(lengths: tuple[int, ...], times: int) -> None:
        out.append((lengths, times))
        for x in lengths:
            left[x] -= times

    def pair(total: int, other: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths of that sum, the longer one as long as can be."""
        a = np.arange(total - 1, (total - 1) // 2, -1)
        a = a[a <= tokens]
        for x in a[(left[a] > 0) & (left[total - a] > 0)].tolist():
            if most((*other, x, total - x)) > 0:
                return x, total - x
        return None

    for longest in range(tokens, 0, -1):
        gap = tokens - longest
        if left[longest] and not gap:
            take((longest,), int(left[longest]))
        if left[longest] and left[gap] and (n := most((longest, gap))):
            take((longest, gap), n)
        while left[longest] and gap > 1 and (found := pair(gap, (longest,))):
            take((longest, *found), most((longest, *found)))
        while left[longest] and gap > 2:
            there = (left[: gap + 1] > 0).astype(np.int64)
            sums = np.convolve(there, there)
            third = np.arange(gap - 2, 0, -1)
            third = third[(left[third] > 0) & (sums[gap - third] > 0)]
            found = next(((x, *p) for x in third.tolist() if (p := pair(gap - x, (longest, x)))), None)
            if found is None:
                break
            take((longest, *found), most((longest, *found)))
        open_bins = []
        while left[longest]:  # as many of the same length together as fit: lengths up to half share a sequence
            copies = min(tokens // longest, int(left[longest]))
            times = int(left[longest]) // copies
            left[longest] -= copies * times
            open_bins.append(((longest,) * copies, tokens - copies * longest, times))
        while open_bins:
            lengths, room, times = open_bins.pop()
            fits = np.flatnonzero(left[1 : room + 1]) + 1
            if not len(fits):
                out.append((lengths, times))
                continue
            best = int(fits[-1])
            n = min(times, int(left[best]))
            left[best] -= n
            if n < times:
                open_bins.append((lengths, room, times - n))
            open_bins.append(((*lengths, best), room - best, n))
    return out


def places(fillings: list[tuple[tuple[int, ...], int]], tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks: sorted keys (length, first rank), the first rank's sequence, and the offset in all of them."""
    used, runs, sequence = [0] * (tokens + 1), [], 0
    for lengths, times in fillings:
        offset = 0
        for x in lengths:
            runs.append((x << 48 | used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def best_fit_packing(pieces: DataFrame, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces (doc_id, piece, length, further columns) with sequence_id and offset added.

    Only the number of pieces per length reaches the driver (one row per length). The plan says which ranks
    within a length go where; a piece finds its rank by a count over groups of its length, so a frequent
    length is numbered by many tasks. Null ids and repeated rows are pieces like any other.
    """
    pieces = written(pieces, "packing-pieces", codec="zstd")
    groups = pieces.count() // ROWS_PER_RANK_GROUP + 1
    pieces = pieces.withColumn("rank_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = pieces.groupBy("length", "rank_group").count()
    counts = np.zeros(tokens + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("count")).collect():
        counts[length] = n
    keys, sequences, offsets = places(plan(counts, tokens), tokens)
    inside = Window.partitionBy("length").orderBy("rank_group").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "rank_group", F.coalesce(F.sum("count").over(inside), F.lit(0)).alias("rank_base"))
    numbered = pieces.withColumn("rank_in_group", F.row_number().over(Window.partitionBy("length", "rank_group").orderBy("doc_id", "piece")) - 1)
    ranked = numbered.join(base, ["length", "rank_group"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        wanted = length.to_numpy() << 48 | rank.to_numpy()
        at = np.searchsorted(keys, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + wanted - keys[at], "offset": offsets[at]})

    placed = ranked.withColumn("place", place("length", F.col("rank_base") + F.col("rank_in_group")))
    return placed.select(*[c for c in pieces.columns if c != "rank_group"], "place.sequence_id", "place.offset")
