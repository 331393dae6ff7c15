"""Substring dedup, the conversation trie and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwise.llm import conversation_trie, hard_negatives, queries, substring_dedup
from shardwise.llm.blocks import Block


def plain_substring(rows: list[tuple], length: int) -> list[tuple]:
    """Every window by its words; order is (no id, id, start)."""
    docs = [(r[0], re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())) for r in rows]
    first: dict[tuple, tuple] = {}
    for i, words in docs:
        for s in range(len(words) - length + 1):
            key, at = tuple(words[s : s + length]), (i is None, i or 0, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if first[tuple(words[s : s + length])] < (i is None, i or 0, s):
                gone[s : s + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        edges = [k for k in range(len(words) + 1) if (k > 0 and gone[k - 1]) != (k < len(words) and gone[k])]
        out.append((i, len(words), sum(gone), list(zip(edges[::2], edges[1::2], strict=True)), kept))
    return sorted(out, key=repr)


def spark_substring(df, **options) -> list[tuple]:
    out = substring_dedup.substring_dedup(df, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in out), key=repr)


@pytest.mark.parametrize("options", [{}, {"length": 6, "seed": 3}, {"length": 6, "seed": 5, "hot": 1, "together": 3}, {"hot": 2, "together": 10}])
def test_substring_dedup(messy, options):
    rows, df = messy
    assert spark_substring(df, **options) == plain_substring(rows, options.get("length", 20))


def test_substring_dedup_of_few_words(spark):
    """Texts of three words in all orders, many repeats inside one text and across, ties, and one very long text."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(60, "a " * 3000), (61, "\x1c\x1d a\x85b " * 40), (62, "a\x0bb\x0cc\r\n" * 30), (None, rows[5][1]), (None, rows[5][1]), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for options in ({"length": 5, "seed": 2}, {"length": 5, "seed": 2, "hot": 3, "together": 5}, {"length": 20, "seed": 8}):
        assert spark_substring(df, **options) == plain_substring(rows, options["length"])


def test_word_bounds_and_ids():
    """Against bytes.split(), document by document: empty texts, no space between documents, white space of Unicode, long words."""
    rng = random.Random(4)
    letters = ["a", "b", "\0", "é", "\x85", "\xa0", "\x1c", "日", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "abcdefgh", "x" * 60, "y" * 70]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).encode() for _ in range(300)]
    texts += [b"", b"a", b"a", b"", b" ", b"z" * 64, b"z" * 65, b"z" * 64 + b"\0", b"z" * 5000, b"a\0", b"abcdefgh", b"abcdefgh\0", b""]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    block = Block(np.arange(len(texts)), np.zeros(len(texts), bool), starts, ends, np.frombuffer(b"".join(texts), np.uint8))
    begin, end = substring_dedup.word_bounds(block)
    words = [w for t in texts for w in t.split()]
    assert [block.data[a:b].tobytes() for a, b in zip(begin, end, strict=True)] == words
    ids = dict(zip(words, substring_dedup.word_ids(block.data, begin, end).tolist(), strict=True))
    assert [ids[w] for w in words] == substring_dedup.word_ids(block.data, begin, end).tolist()
    assert len(set(ids.values())) == len(ids)
    none = substring_dedup.word_bounds(Block(*(np.empty(0, t) for t in (np.int64, bool, np.int64, np.int64, np.uint8))))
    assert [len(x) for x in none] == [0, 0]


def test_substring_dedup_of_nothing(nothing):
    assert spark_substring(nothing) == []


def plain_trie(rows: list[tuple]) -> list[tuple]:
    convs: dict[int, list[tuple]] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {c: convs.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + turns[h:] for c, turns in convs.items()}
    members: dict[tuple, list[int]] = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, int] = {}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def spark_trie(df, **options) -> list[tuple]:
    return sorted((tuple(r) for r in conversation_trie.conversation_trie(df, **options).select(*COLUMNS).collect()), key=repr)


def messy_conversations() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), 100, 101, 150, 223, 224, 225, 301, 302, -1, -100, -7, 2**62]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "né?", "日本", "", "ok then"])))
    rows += [(500, t, "user", f"turn {t}") for t in range(700)]  # long, shared by two of its hundred
    rows += [(501, t, "user", f"turn {t}") for t in range(700)] + [(502, t, "user", f"turn {t}") for t in range(0, 620)]
    rows += [(7, None, "user", "first"), (7, None, "assistant", "first"), (9, 0, None, None), (9, 0, "user", "tie"), rows[3], rows[3], (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(640, 1, "user", "alone")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_turns": 3, "queue_limit": 2}, {"shard_turns": 100}])
def test_conversation_trie(spark, options):
    rows = messy_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    df = df.withColumns({c: F.lit("clash") for c in ("a", "b", "depth", "digest", "stretch", "level", "top", "n", "h", "base", "length", "chars", "ends")})
    assert spark_trie(df, **options) == plain_trie(rows)


def test_conversation_trie_of_one_conversation_and_of_none(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert spark_trie(spark.createDataFrame([], schema)) == []
    rows = [(1234, t, "user", "x" * t) for t in range(3)] + [(1200, 0, "user", "base")]
    assert spark_trie(spark.createDataFrame(rows, schema)) == plain_trie(rows)


def test_ends_of_many_members_come_from_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "_CHUNK", 64)
    rows = [(1000 * c + 51, 0, "user", "same") for c in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert spark_trie(df) == plain_trie(rows)


def test_spilling_queue_gives_rows_in_order():
    rng = random.Random(2)
    queue, waiting, out = conversation_trie.SpillingQueue(2, 5), [], []
    for _ in range(3000):
        if rng.random() < 0.6 or not waiting:
            row = (rng.randint(-50, 50), rng.randint(0, 9))
            queue.push(row), waiting.append(row)
        else:
            assert queue.first() == min(waiting)
            out.append(queue.pop())
            waiting.remove(out[-1])
    while queue.first() is not None:
        assert queue.pop() == waiting.pop(waiting.index(min(waiting)))
    assert not waiting


def plain_negatives(rows: list[tuple], is_anchor, positives=5, negatives=3, low=50, high=95, scale=256) -> list[tuple]:
    kept = set()
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            kept.add((i, label, tuple(int(np.floor(np.float64(x) * scale)) for x in v)))
    out = []
    for i, label, x in kept:
        if is_anchor(i):
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, other, y in kept if j != i and len(y) == len(x))
            for s, j, _ in [r for r in scored if r[2] == label][:positives]:
                hard = [(-t, n) for t, n, other in scored if other != label and low * -s <= 100 * -t <= high * -s][:negatives]
                out += [(i, j, r + 1, n, -s, t) for r, (t, n) in enumerate(hard)]
    return sorted(out)


def messy_vectors(rng, n=160, dim=12) -> list[tuple]:
    centres = rng.normal(size=(4, dim))
    rows = [(int(k), [float(x) for x in np.float32(centres[k % 4] + rng.normal(size=dim) * 0.8)], int(rng.integers(0, 4))) for k in range(n)]
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(30)]  # one vector many times
    rows += [(2000, None, 1), (2001, [], 1), (2002, [float("nan")] * dim, 1), (2003, [None, *rows[0][1][1:]], 1), (2004, rows[1][1], None), (None, rows[1][1], 1), (2005, [float("inf"), *rows[0][1][1:]], 2)]
    rows += [(2010 + k, [float(k), 1.0, -2.0], k % 2) for k in range(6)]  # another dimension
    rows += [rows[10], rows[10], (20, rows[21][1], 2), (30, [0.0] * dim, 1), (2020, [0.0] * dim, 0)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block_rows": 7}, {"positives": 2, "negatives": 9, "lowest": 0, "highest": 100}])
def test_hard_negatives(spark, options):
    rows = messy_vectors(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    df = df.withColumns({c: F.lit("clash") for c in ("x", "dim", "mark", "anchor", "number", "kind", "data", "near", "rank", "score")})
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **options)
    got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    plain = {k: v for k, v in options.items() if k != "block_rows"}
    wanted = plain_negatives(rows, lambda i: i % 5 == 0, plain.get("positives", 5), plain.get("negatives", 3), plain.get("lowest", 50), plain.get("highest", 95))
    assert got == wanted and wanted


def test_hard_negatives_with_large_components(spark):
    rows = [(k, [float(2**18 + k), float(k % 3), -1.5e5 * (k % 2)], k % 2) for k in range(40)]
    schema = "vec_id long, embedding array<double>, label int"
    out = hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), lowest=0, highest=100)
    got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows, lambda i: True, low=0, high=100)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(spark.createDataFrame([(1, [2.0**40], 1)], schema))


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df).count() == 0


def test_vertical_scan_reads_part_of_what_it_compares():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(3000, 64)) * np.linspace(2, 0.05, 64)).astype(np.int64)
    block = hard_negatives.Columns(np.arange(3000), np.zeros(3000, np.int64), x, True)
    ids, scores = hard_negatives.nearest(block, 0, 0, x[0], 5)
    every = x @ x[0]
    every[0] = -(2**60)
    best = np.lexsort((np.arange(3000), -every))[:5]
    assert ids.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert block.read < 0.8 * x.size


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_substring_dedup", "op13_hard_negatives"])
def test_queries_equal_sql(spark, sf_dir, name):
    from compare import database, difference

    assert difference(queries.QUERIES[name](spark, sf_dir).toPandas(), database(sf_dir).sql(queries.SQL[name]).df()) == ""
