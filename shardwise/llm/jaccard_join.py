"""Near-duplicate documents: exact Jaccard links between word shingle sets, by prefixes under several token orders."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.blocks import BUCKET_BYTES, Block, ask, blocks, bucket_slices, mix, pack, reply_list, unpack
from shardwise.llm.components import components
from shardwise.llm.store import giving_back, release, sorted_groups, written

ORDERS = 3
#: Documents of one candidate component that a task compares with each other, or with as many others.
CHUNK_DOCS = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def shingles(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every document of a block: (document, hash), sorted by document, then hash.

    ASCII capitals count as small letters; words are what ASCII white space leaves. Fewer words than a shingle
    has make one shingle of all of them.
    """
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if not len(block.data):
        return none
    space = _SPACE[block.data]
    edge = np.zeros(len(space), bool)
    edge[block.starts[block.starts < len(space)]] = True
    begin = np.flatnonzero(~space & (edge | np.append(True, space[:-1])))
    if not len(begin):
        return none
    stop = np.flatnonzero(~space & np.append(space[1:] | edge[1:], True)) + 1
    powers, inverse = _powers(len(space))
    sums = np.zeros(len(space) + 1, np.uint64)
    np.cumsum((_LOWER[block.data].astype(np.uint64) + np.uint64(1)) * powers[: len(space)], out=sums[1:])
    word = mix((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))
    doc = (np.searchsorted(block.ends, begin, side="right")).astype(np.int64)
    count = np.bincount(doc, minlength=len(block.ids))
    # As many words as there are, up to `words`, from each place where so many follow, or from the first.
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[doc]
    head = np.flatnonzero((place + words <= count[doc]) | ((place == 0) & (count[doc] < words)))
    taken = np.minimum(count[doc[head]], words)
    h = np.zeros(len(head), np.uint64)
    for i in range(words):
        more = taken > i
        h[more] = mix(h[more] + word[head[more] + i] * np.uint64(2 * i + 3) + np.uint64(i + 1))
    order = np.lexsort((h, doc[head]))
    d, h = doc[head][order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _ask_counts(words: int, buckets: int):
    def question(payload: bytes, _: list[bytes]) -> Iterator[tuple[int, bytes]]:
        _, h = shingles(Block.load(payload), words)
        tokens, counts = np.unique(h, return_counts=True)
        for bucket, a, b in bucket_slices(tokens, buckets):
            many = counts[a:b] > 1
            yield bucket, struct.pack("<q", b - a) + np.packbits(many).tobytes() + counts[a:b][many].astype(np.uint32).tobytes() + tokens[a:b].astype(np.uint32).tobytes()

    return question


def _frequency_classes(asked: list[bytes]) -> list[bytes]:
    """Class of each token: 0 if one document has it, else the bit length of its document count less one.

    Tokens of a bucket that agree in their low 32 bits count together: any fixed order of tokens is a valid one,
    and the sum is never below a token's own count.
    """
    sizes, tokens, counts = [], [], []
    for blob in asked:
        (n,) = struct.unpack_from("<q", blob)
        bits = -(-n // 8)
        many = np.unpackbits(np.frombuffer(blob, np.uint8, bits, 8), count=n).astype(bool)
        own = np.ones(n, np.int64)
        own[many] = np.frombuffer(blob, np.uint32, int(many.sum()), 8 + bits)
        sizes.append(n)
        counts.append(own)
        tokens.append(np.frombuffer(blob, np.uint32, n, 8 + bits + 4 * int(many.sum())))
    distinct, place = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    classes = np.where(total < 2, 0, np.floor(np.log2(np.maximum(total, 1))).astype(np.int64)).astype(np.uint8)
    return [pack(c) for c in np.split(classes[place], np.cumsum(sizes)[:-1])]


def order_keys(tokens: np.ndarray, order: int) -> np.ndarray:
    """Place of tokens within their frequency class under one of the global orders."""
    return mix(tokens ^ mix(np.array([order + 1], np.uint64)))


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """First tokens of a set of which any linked set must hold one: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def in_prefix(doc: np.ndarray, tokens: np.ndarray, classes: np.ndarray, limit: np.ndarray, order: int) -> np.ndarray:
    """Whether each (document, token) is among the first limit[document] of its set: rare classes first, then by order."""
    by = np.lexsort((order_keys(tokens, order), classes, doc))
    d = doc[by]
    starts = np.searchsorted(d, d, side="left")
    out = np.zeros(len(doc), bool)
    out[by] = np.arange(len(d)) - starts < limit[d]
    return out


def _documents(words: int, percent: int, buckets: int):
    """Every document: doc_id, its set's size and signature; for those that can have links their tokens that others
    share, with classes. A document can have links only if under every order its prefix holds a shared token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.load(batch.column(0)[i].as_py())
                doc, h = shingles(block, words)
                n_docs = len(block.ids)
                tokens, place = np.unique(h, return_inverse=True)
                replies = reply_list(batch.column(1)[i].as_py())
                classes = np.concatenate([np.frombuffer(unpack(r), np.uint8) for r in replies])[place] if len(tokens) else np.empty(0, np.uint8)
                n = np.bincount(doc, minlength=n_docs)
                first = np.cumsum(n) - n
                full = n > 0
                mark = np.zeros((2, n_docs), np.uint64)
                if len(h):
                    mark[0, full] = np.add.reduceat(mix(h ^ np.uint64(0x5555)), first[full])
                    mark[1, full] = np.add.reduceat(mix(h + np.uint64(0x7777)), first[full])
                signature = [mark[:, d].tobytes() if full[d] else None for d in range(n_docs)]
                shared = classes > 0
                # Tokens of one document come first in every order, so each prefix has a shared token or none has.
                alone = n - np.bincount(doc[shared], minlength=n_docs)
                active = full & ~block.null & (alone < prefix_sizes(n, percent))
                best: dict[bytes, int] = {}
                for d in np.flatnonzero(active).tolist():
                    s = signature[d]
                    if s not in best or block.ids[d] < block.ids[best[s]]:
                        best[s] = d
                sets, kinds = [None] * n_docs, [None] * n_docs
                for d in best.values():
                    a, b = first[d], first[d] + n[d]
                    sets[d], kinds[d] = h[a:b][shared[a:b]].tobytes(), classes[a:b][shared[a:b]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64(), mask=block.null), pa.array(n, pa.int64()), pa.array(signature, pa.binary()), pa.array(sets, pa.binary()), pa.array(kinds, pa.binary())],
                    ["doc_id", "n", "signature", "tokens", "classes"],
                )

    return run


def _prefix_of(n: int, tokens: np.ndarray, classes: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The shared tokens in a set's prefix; `n` counts its unshared ones too, which come first."""
    limit = int(prefix_sizes(np.array([n]), percent)[0]) - (n - len(tokens))
    return tokens[np.lexsort((order_keys(tokens, order), classes))[:limit]]


def _prefix_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = [], []
            for i in range(batch.num_rows):
                doc, n, t, c = (batch.column(j)[i].as_py() for j in range(4))
                p = _prefix_of(n, np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint8), percent, 0)
                tokens.append(p)
                ids.append(np.full(len(p), doc))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(tokens).view(np.int64))], ["doc_id", "token"])

    return run


def _verify(percent: int):
    """Links among the documents of a chunk, or between those of two chunks of a candidate component."""

    def task(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, low, high = key
        ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        chunk = table.column("chunk").to_numpy()
        by = np.lexsort((ids, n))
        raw_t, raw_c = table.column("tokens").to_pylist(), table.column("classes").to_pylist()
        sets = [np.frombuffer(raw_t[i], np.uint64) for i in by.tolist()]
        kinds = [np.frombuffer(raw_c[i], np.uint8) for i in by.tolist()]
        ids, n, chunk = ids[by], n[by], chunk[by]
        size = np.array([len(s) for s in sets])
        ends = np.cumsum(size)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        code_of = [code[e - s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
        every = np.concatenate(sets)
        prefixes = []
        for order in range(ORDERS):
            limit = prefix_sizes(n, percent) - (n - size)
            doc = np.repeat(np.arange(len(n)), size)
            chosen = in_prefix(doc, every, np.concatenate(kinds), limit, order)
            per = np.bincount(doc[chosen], minlength=len(n))
            prefixes.append((code[chosen], np.cumsum(per), per))
        mark = np.zeros(int(code.max()) + 1, bool)
        group = np.arange(len(n))
        links = []
        last = np.searchsorted(n, n * 100 // percent, side="right")
        for i in range(len(n)):
            others = np.arange(i + 1, int(last[i]))
            if low != high:
                others = others[chunk[others] != chunk[i]]
            for codes, stops, per in prefixes:
                # Candidates must share a prefix token under each order; one filter after the other.
                if not len(others):
                    break
                own = codes[stops[i] - per[i] : stops[i]]
                mark[own] = True
                some = others[per[others] > 0]
                at = np.repeat(stops[some] - np.cumsum(per[some]), per[some]) + np.arange(per[some].sum())
                hits = np.add.reduceat(mark[codes[at]], np.cumsum(per[some]) - per[some]) if len(some) else np.empty(0)
                mark[own] = False
                others = some[hits > 0]
            others = others[group[others] != group[i]]
            if not len(others):
                continue
            mark[code_of[i]] = True
            at = np.repeat(ends[others] - np.cumsum(size[others]), size[others]) + np.arange(size[others].sum())
            common = np.add.reduceat(mark[code[at]].astype(np.int64), np.cumsum(size[others]) - size[others])
            mark[code_of[i]] = False
            linked = others[100 * common >= percent * (n[i] + n[others] - common)]
            for j in linked.tolist():
                if group[j] != group[i]:
                    links.append((ids[i], ids[j]))
                    group[group == group[j]] = group[i]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    Two documents link if 100 * common shingles >= percent * all shingles of both. Tokens are ordered by how many
    documents have them (classes, rarest first) and inside a class by ORDERS different hashes; of linked documents
    each must hold, under every order, one of the other's first tokens. So documents with enough tokens of their own
    drop out at once; equal sets are one from there on. Sets that share a first token under the first order form
    candidate components; in chunks of them each pair must pass the prefixes of all orders before its sets are compared
    in full, unless links already join the two. Large components are compared chunk by chunk, in many tasks.

    Null text counts as empty; empty texts link with nothing. Rows that share an id are one node; rows without id
    have no links and no component. Repeated rows are all returned.
    """
    base, total = blocks(docs, "jaccard-blocks", id_col, text_col)
    buckets = int(total // bucket_bytes) + 1
    counted = base.join(ask(base, _ask_counts(words, buckets), _frequency_classes), "block", "left").select("payload", "replies")
    table = written(counted.mapInArrow(giving_back(_documents(words, percent, buckets)), "doc_id long, n long, signature binary, tokens binary, classes binary"), "jaccard-sets")
    release(base)
    known = table.where("signature is not null and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("rep"))
    # Rows that share an id are one node: their different sets are joined under it.
    reps = written(known, "jaccard-signatures")
    active = table.where("tokens is not null").join(reps.select("signature", "rep"), "signature").where("doc_id = rep").select("doc_id", "n", "tokens", "classes", "signature")
    active = written(active.dropDuplicates(["signature"]).select("doc_id", "n", "tokens", "classes"), "jaccard-active")
    rows = active.mapInArrow(giving_back(_prefix_rows(percent)), "doc_id long, token long")
    hubs = rows.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far")).where("hub <> far").select("token", "hub")
    near = components(rows.join(hubs, "token").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")), "jaccard-near")
    chunks = near.groupBy("component").agg(F.count("*").alias("docs")).withColumn("chunks", F.ceil(F.col("docs") / chunk_docs).cast("int"))
    members = near.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    keyed = members.select("component", F.col("node").alias("doc_id"), "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    keyed = keyed.select("component", "doc_id", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    links = sorted_groups(keyed.join(active, "doc_id"), ["component", "low", "high"], _verify(percent), "a long, b long")
    same_id = table.where("signature is not null and doc_id is not null").join(reps, "signature").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    shared_id = same_id.join(table.where("doc_id is not null and signature is not null").groupBy("doc_id").agg(F.count_distinct("signature").alias("sets")).where("sets > 1"), F.col("a") == F.col("doc_id")).select("a", "b")
    found = components(links.unionByName(shared_id), "jaccard-links")
    release(active)
    # Through the signature every copy finds its set's component; an id with several sets finds it by itself.
    named = reps.join(found, reps["rep"] == found["node"], "left").select("signature", F.coalesce("component", "rep").alias("by_set"))
    out = table.select("doc_id", "n", "signature").join(named, "signature", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("by_set", "doc_id")).alias("component_id"))
