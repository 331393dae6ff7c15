"""Conversations as token trees: shared first turns are written once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.packing import encoder, vocabulary
from shardwise.llm.pieces import Decoder, worker_store
from shardwise.llm.store import release, sorted_groups, written

#: Strings that mark turns, here or in other common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns below a node from which on it is a stream of its own, so that no tree is larger than a task.
STREAM_TURNS = 20_000

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes doubled, and one put inside every control string, so that none is left whole."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As escape(), and on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def _turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: its node (hash of all turns up to it), the node before, role, text and the turns from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                conv, turns = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                node, rows = None, []
                for depth, t in enumerate(turns):
                    parent, role = node, t["role"].encode()
                    node = hashlib.blake2b((parent or b"") + len(role).to_bytes(8, "little") + role + t["text"].encode(), digest_size=16).digest()
                    rows.append((conv, depth, node, parent, t["role"], t["text"], len(turns) - depth))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "depth", "node", "parent", "role", "text", "below"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("row").alias("turns"))
    return whole.unionByName(alone).mapInArrow(run, "conv_id long, depth int, node binary, parent binary, role string, text string, below long")


def _encoded(nodes: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Nodes (node, parent, depth, role, text) with tokens, their number and the loss span: each node is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_store(f"pack:{vocabulary_path}:{pattern}", lambda: encoder(vocabulary_path, pattern))
        for batch in batches:
            if not batch.num_rows:
                continue
            roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ids = memory.texts([part for r, t in zip(roles, texts, strict=True) for part in (f"{START}{escape_role(r)}\n", escape(t), END)])
            tokens = [b"".join(ids[i : i + 3]) for i in range(0, len(ids), 3)]
            learns = [r == "assistant" for r in roles]
            a = [len(h) // 4 if own else 0 for h, own in zip(ids[::3], learns, strict=True)]
            b = [x + len(t) // 4 if own else 0 for x, t, own in zip(a, ids[1::3], learns, strict=True)]
            columns = [pa.array([len(t) // 4 for t in tokens], pa.int64()), pa.array(tokens, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["node", "parent", "depth", "length", "tokens", "loss_start", "loss_end"])

    return nodes.select("node", "parent", "depth", "role", "text").mapInArrow(run, "node binary, parent binary, depth int, length long, tokens binary, loss_start long, loss_end long")


def _emit(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """One stream depth first: offsets, and the intervals of the stream and of streams above that a node sees."""
    rows = {r["node"]: r for r in table.to_pylist()}
    children: dict[bytes | None, list[bytes]] = {}
    for node, r in rows.items():
        children.setdefault(r["parent"] if r["parent"] in rows else None, []).append(node)
    (root,) = children[None]
    above = [{"stream": a["node"], "start": 0, "end": a["length"]} for a in rows[root]["above"] or []]
    out, at, stack = [], 0, [(root, above)]
    while stack:
        node, sees = stack.pop()
        r, start = rows[node], at
        at += r["length"]
        out.append((key[0], node, r["parent"], r["depth"], start, at, r["position"], r["tokens"], r["loss_start"], r["loss_end"], sees))
        last = sees[-1] if sees else None
        joined = last is not None and last["stream"] == key[0] and last["end"] == start
        seen = [*sees[:-1], {**last, "end": at}] if joined else [*sees, {"stream": key[0], "start": start, "end": at}]
        stack += [(child, seen) for child in sorted(children.get(node, []), reverse=True)]
    interval = pa.list_(pa.struct([("stream", pa.binary()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), interval]
    names = ["stream", "node", "parent", "depth", "start", "end", "position", "tokens", "loss_start", "loss_end", "attends"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def format_tree(conversations: DataFrame, vocabulary_path: str, pattern: str, stream_turns: int = STREAM_TURNS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) to (segments, index).

    segments: each distinct beginning of a conversation once: stream, node, parent, depth, start and end (token
    offsets in the stream, depth first, without gaps), position (of its first token in any conversation), tokens
    (little-endian unsigned 32-bit ids), loss_start and loss_end (inside tokens: an assistant's text), attends
    (intervals of tokens before it that it sees: all its ancestors and nothing else, neighbours joined).
    index: conv_id, depth, node. Nodes with more than `stream_turns` turns below them are streams of their own,
    so a first turn that a third of all conversations share splits into many streams.

    Rows are ordered by turn, then role and text. Null role or text counts as empty; each row without
    conv_id is a conversation of its own. A conversation is one sequence and must fit a task. Equal conversations share a last node.
    """
    turns = written(_turns(conversations), "chat-turns", "zstd")
    texts = turns.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("parent", "depth", "role", "text")])
    nodes = written(_encoded(texts, vocabulary_path, pattern), "chat-nodes", "zstd")
    narrow = turns.select("conv_id", "depth", "node", "below")
    split = narrow.groupBy("node").agg((F.sum("below") > stream_turns).alias("split"))
    steps = narrow.join(nodes.select("node", "length").join(split, "node"), "node").select("conv_id", F.struct("depth", "node", "length", "split").alias("step"))
    # A turn without conversation is a path by itself; equal ones are one path, put together before the exchange.
    single = F.when(F.col("conv_id").isNull(), F.col("step.node")).alias("single")
    paths = steps.groupBy("conv_id", single).agg(F.sort_array(F.collect_set("step")).alias("path"))
    paths = paths.withColumn("cut", F.size(F.filter("path", lambda s: s["split"])))
    placed = paths.select("path", "cut", F.posexplode("path").alias("depth", "step"))
    inner = F.get(F.col("path"), F.col("cut"))["node"]
    before = F.slice("path", 1, F.col("depth"))
    head = F.when(F.col("depth") <= F.col("cut"), F.transform(before, lambda s: F.struct(s["node"].alias("node"), s["length"].alias("length"))))
    position = F.aggregate(before, F.lit(0).cast("long"), lambda n, s: n + s["length"])
    placed = placed.select(F.col("step.node").alias("node"), F.when(F.col("step.split"), F.col("step.node")).otherwise(inner).alias("stream"), head.alias("above"), position.alias("position"))
    streams = placed.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("stream", "above", "position")])
    schema = "stream binary, node binary, parent binary, depth int, start long, end long, position long, tokens binary, loss_start long, loss_end long, attends array<struct<stream:binary,start:long,end:long>>"
    segments = written(sorted_groups(nodes.join(streams, "node"), ["stream"], _emit, schema), "chat-segments", "zstd")
    release(nodes)
    return segments, turns.select("conv_id", "depth", "node")


def read_back(segments: DataFrame, index: DataFrame, vocabulary_path: str) -> DataFrame:
    """Turns as the tokens have them: conv_id, depth, role, text, loss_text (null without loss), chars (formatted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_store(f"decode:{vocabulary_path}", lambda: Decoder(vocabulary(vocabulary_path)))
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                node, tokens, a, b = (batch.column(c)[i].as_py() for c in range(4))
                text = decoder.decode(tokens).decode()
                role, _, body = text.removeprefix(START).removesuffix(END).partition("\n")
                loss = unescape(decoder.decode(tokens[4 * a : 4 * b]).decode()) if b else None
                rows.append((node, unescape_role(role), unescape(body), loss, len(text)))
            if rows:
                kinds = [pa.binary(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "role", "text", "loss_text", "chars"])

    plain = segments.select("node", "tokens", "loss_start", "loss_end").mapInArrow(run, "node binary, role string, text string, loss_text string, chars long")
    return index.join(plain, "node").drop("node")
