"""Deduplicating operators against plain Python."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardwise.llm import suffix_dedup as suffix_module
from shardwise.llm.blocks import Block, pack, unpack
from shardwise.llm.components import components
from shardwise.llm.exact_dedup import exact_dedup
from shardwise.llm.jaccard_join import jaccard_components, shingles
from shardwise.llm.line_dedup import line_dedup
from shardwise.llm.suffix_dedup import _holders, refine, suffix_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def key(row):
    return (row is None or row[0] is None, *[str(x) for x in row])


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def brute_exact(rows):
    norm = [SPACE.sub(" ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm, strict=True):
        groups[t].append(r[0])
    return sorted(((r[0], least(groups[t]), len(groups[t]), r[0] == least(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm, strict=True)), key=key)


def test_exact_dedup(messy):
    rows, df = messy
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.sha256.hex()) for r in exact_dedup(df, digest_all=True).collect()]
    assert sorted(got, key=key) == brute_exact(rows)


def test_exact_dedup_hashes_survivors_only(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, "a text of its own length")], "doc_id long, text string")
    assert {r.doc_id: r.sha256 is not None for r in exact_dedup(df).collect()} == {1: True, 2: True, 3: False}


def brute_lines(rows, sites):
    spread, first = defaultdict(set), {}
    for i, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" ")
            if k:
                if s is not None:
                    spread[k].add(s)
                first.setdefault(k, set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [len(spread[x.strip(" ")]) >= sites and i != least(first[x.strip(" ")]) if x.strip(" ") else False for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return sorted(out, key=key)


@pytest.mark.parametrize("sites", [2, 3, 10, 14])
def test_line_dedup(messy, sites):
    rows, df = messy
    df = df.drop("site")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(df, min_sites=sites).collect()]
    want = brute_lines(rows, sites)
    assert sorted(got, key=key) == want
    assert sum(w[3] for w in want) > 0


def test_line_dedup_writes_no_small_tables(messy, monkeypatch):
    """Only the hashes of all lines are written: few boilerplate lines are not spread over a file for each partition."""
    from shardwise.llm import store

    names = []
    monkeypatch.setattr(store, "scratch_dir", lambda spark, name, made=store.scratch_dir: names.append(name) or made(spark, name))
    line_dedup(messy[1]).count()
    assert names == ["line-hashes"]


def brute_suffix(rows, length=50):
    holder = {}
    top = 2**62
    data = [((top if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            holder[w] = min(holder.get(w, top), i)
    out = []
    for (i, b), r in zip(data, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if holder[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes().hex()))
    return sorted(out, key=key)


def test_suffix_dedup(messy):
    rows, df = messy
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).hex()) for r in suffix_dedup(df, bucket_bytes=3000).collect()]
    want = brute_suffix(rows)
    assert sorted(got, key=key) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_suffix_dedup_keeps_characters_whole(spark):
    rows = [(1, "a" + "é" * 60), (2, "é" * 60 + "ü"), (3, " " + "é" * 30)]
    out = {r.doc_id: r.kept for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()}
    assert out == {1: rows[0][1], 2: "ü", 3: " "}


def test_refinement_sorts_suffixes():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2, n).astype(np.uint8).tobytes() for n in (200, 150, 60, 49, 50)] + [b"\0" * 130, b"ab" * 60]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    where, bucket = refine(data, ends - [len(p) for p in parts], ends, 50)
    windows = [data[p : p + 50].tobytes() for p in where]
    assert len(where) == sum(max(0, len(p) - 49) for p in parts)
    order = sorted(range(len(where)), key=lambda i: windows[i])
    pointers = [bucket[i] for i in order]
    assert pointers == sorted(pointers)
    assert len(set(pointers)) == len(set(windows))


def test_copied_fragments_are_sorted_once(monkeypatch):
    """Forty blocks ask about the same two fragments of one key: their bytes are sorted once, for the smallest id of each."""
    texts, sorted_bytes = [b"a" * 50 + b"b" * 9, b"c" * 7 + b"a" * 50], []
    monkeypatch.setattr(suffix_module, "refine", lambda data, *rest: sorted_bytes.append(len(data)) or refine(data, *rest))

    def asked(least):
        raw = struct.pack("<q", 2) + np.array([5, 5], np.uint64).tobytes() + np.array(least, np.int64).tobytes()
        return pack(raw + bytes(len(t) - 49 for t in texts) + b"".join(texts))

    replies = _holders(50)([asked([100 - i, 30 + i]) for i in range(40)])
    assert sum(sorted_bytes) == sum(map(len, texts))
    want = [30] + [61] * 9, [30] * 8  # the window of fifty times "a" is in both
    for reply in replies:
        raw = unpack(reply)
        n, m = struct.unpack_from("<qq", raw)
        per, span, ids = np.frombuffer(raw, np.uint8, n, 16), np.frombuffer(raw, np.uint8, m, 16 + n), np.frombuffer(raw, np.int64, m, 16 + n + m)
        holders = np.repeat(ids, span).tolist()
        assert per.sum() == m and holders == want[0] + want[1]


def brute_shingles(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in SPACE.split(low) if x]
    return ({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}) if w else set()


def brute_jaccard(rows, words, percent):
    sets = [brute_shingles(r[1], words) for r in rows]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets, strict=True)), key=key)


@pytest.mark.parametrize(("words", "percent", "chunk"), [(3, 90, 1024), (5, 80, 1024), (3, 90, 4)])
def test_jaccard_components(messy, words, percent, chunk):
    rows, df = messy
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, words, percent, bucket_bytes=20_000, chunk_docs=chunk).collect()]
    want = brute_jaccard(rows, words, percent)
    assert sorted(got, key=key) == want
    assert max(Counter(w[2] for w in want).values()) > 5


def test_shingles_of_a_block():
    texts = [b"", b"A b", b" a  b\tc a b c", b"a b c", b"x"]
    ends = np.cumsum([len(t) for t in texts])
    block = Block(np.arange(5), np.zeros(5, bool), ends - [len(t) for t in texts], ends, np.frombuffer(b"".join(texts), np.uint8))
    doc, h = shingles(block, 3)
    assert np.bincount(doc, minlength=5).tolist() == [0, 1, 3, 1, 1]
    assert set(h[doc == 3]) < set(h[doc == 2])


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "test").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}


def test_empty_tables(nothing):
    assert exact_dedup(nothing).count() == 0
    assert line_dedup(nothing).count() == 0
    assert suffix_dedup(nothing).count() == 0
    assert jaccard_components(nothing).count() == 0
