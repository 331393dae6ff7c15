"""Tokens, packing, shards, search, chat and quality against plain Python and public libraries."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from shardwise.llm import bpe, chat, queries
from shardwise.llm.bpe import Codec, encode_documents, read_ranks
from shardwise.llm.cover_search import CoverTree, search, top_k
from shardwise.llm.packing import best_fit_packing, document_encoder, encoder, plan, tokenized_pieces
from shardwise.llm.pieces import cut
from shardwise.llm.quality import calibrate, fit_quality, score_quality
from shardwise.llm.sharding import shard, splitters


def key(row):
    return tuple(str(x) for x in row)


ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "²", "_", "'s", "\x1c", " ", "日", "😀", "#", "aaa", "the", " the", "\r\n", "<|endoftext|>"]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "a" * 20_000, "ab" * 3000, " " * 3000, "日本語" * 2000]


def test_cut_parts_join_again():
    for text in odd_texts(2000):
        assert " ".join(cut(text)) == text


def test_rank_queue_equals_tiktoken():
    ranks = read_ranks(queries.RANKS)
    own, theirs = Codec(ranks, queries.PATTERN), tiktoken.Encoding("t", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(3000)
    ids = own.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [theirs.encode_ordinary(t) for t in texts]
    assert [own.decode(i) for i in ids] == [t.encode() for t in texts]


@pytest.mark.parametrize("many", [1, 4, 10**9])
def test_merging_by_arrays_equals_tiktoken(monkeypatch, many):
    """Ranks made up so that longer tokens often have lower ones, texts of three letters, runs that overlap themselves."""
    monkeypatch.setattr(bpe, "MANY", many)
    for seed in range(12):
        rng = random.Random(seed)
        pool = [b"a", b"b", b"c"]
        for _ in range(60):
            pool.append(rng.choice(pool) + rng.choice(pool))
        longer = list(dict.fromkeys(t for t in pool if 1 < len(t) < 12))
        rng.shuffle(longer)
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(longer)}
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a" * 100, "ab" * 40]
        theirs = tiktoken.Encoding("t", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [np.frombuffer(i, "<u4").tolist() for i in Codec(ranks, queries.PATTERN).encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_most_merges_are_done_by_arrays():
    """Many different words: few of their pairs are looked up one by one."""

    class Counted(dict):
        looked = 0

        def get(self, *key):
            Counted.looked += 1
            return super().get(*key)

    codec, rng = Codec(read_ranks(queries.RANKS), queries.PATTERN), random.Random(2)
    codec.merger.pairs.rank = Counted(codec.merger.pairs.rank)
    texts = [" ".join("".join(rng.choice(["er", "tion", "keit", "ou", "en", "ß", "th"]) for _ in range(5)) for _ in range(200)) for _ in range(50)]
    codec.encode(texts)
    assert 0 < Counted.looked < 0.2 * sum(len(t) for t in texts)


def test_forgetting_changes_nothing():
    codec = Codec(read_ranks(queries.RANKS), queries.PATTERN)
    texts = odd_texts(300)
    first = codec.encode(texts)
    codec.memory.limit = 1
    assert [codec.encode([t])[0] for t in texts] == first


def test_encode_documents(messy, nothing):
    rows, df = messy
    theirs = tiktoken.Encoding("t", pat_str=queries.PATTERN, mergeable_ranks=read_ranks(queries.RANKS), special_tokens={})
    want = [(r[0], np.array(theirs.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows]
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in encode_documents(df, queries.RANKS, queries.PATTERN).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert encode_documents(nothing, queries.RANKS, queries.PATTERN).count() == 0


def test_packing_encoder_equals_tokenizers():
    t = Tokenizer.from_file(queries.PACK_VOCABULARY)
    t.encode_special_tokens = True
    texts = odd_texts(500)
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder(queries.PACK_VOCABULARY, queries.PATTERN).texts(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x<|endoftext|>y", "  <|endoftext|>\n b", "<|endoftext| >", "<|endof<|endoftext|>text|>"]


def test_packing_keeps_added_tokens(spark):
    """Against the tokenizers library as it comes: it looks for added tokens unless told otherwise."""
    t = Tokenizer.from_file(queries.PACK_VOCABULARY)
    texts = ADDED + odd_texts(500)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(i, "<u4").tolist() for i in document_encoder(queries.PACK_VOCABULARY, queries.PATTERN)(texts)] == want
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenized_pieces(df, queries.PACK_VOCABULARY, queries.PATTERN).collect()}
    assert got == {i: [*want[i], 0] for i in range(len(ADDED))}


def test_packing_with_other_added_tokens(tmp_path):
    """Several tokens, one the beginning of another, some with spaces; then one that takes in its surroundings."""
    texts = [f"{a}{s}{b}{u}" for a in ("", "a ", "b\n") for s in ("<e>", "<e>f", "two words", " <w> ") for b in ("", " c", "  ") for u in ("<e>", "two  words")]
    plain = [{"id": 50257 + i, "content": c, "special": i % 2 == 0} for i, c in enumerate(("<e>", "<e>f", "two words"))]
    for name, added in (("plain", plain), ("wide", [*plain, {"id": 50260, "content": "<w>", "special": True, "lstrip": True, "rstrip": True}])):
        file = json.loads(Path(queries.PACK_VOCABULARY).read_text(encoding="utf-8"))
        every = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
        file["added_tokens"] += [every | a for a in added]
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(file), encoding="utf-8")
        t = Tokenizer.from_file(str(path))
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(i, "<u4").tolist() for i in document_encoder(str(path), queries.PATTERN)(texts)] == want


def test_plan_uses_every_piece_and_few_sequences():
    rng = np.random.default_rng(0)
    for n in (1, 40, 3000, 100_000):
        lengths = np.clip(rng.lognormal(5.5, 1.2, n).astype(int), 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        used, bins = np.zeros(2049, int), 0
        for filling, times in plan(counts, 2048):
            assert sum(filling) <= 2048
            bins += times
            for x in filling:
                used[x] += times
        assert (used == counts).all()
        if n >= 3000:
            assert bins <= 1.002 * lengths.sum() / 2048 + 2


def test_plan_prefers_exact_complements():
    counts = np.zeros(11, int)
    counts[[6, 4, 5, 3, 2, 1]] = [1, 1, 1, 1, 1, 0]
    assert plan(counts, 10) == [((6, 4), 1), ((5, 3, 2), 1)]


def test_packing(messy, nothing):
    rows, df = messy
    pieces = tokenized_pieces(df, queries.PACK_VOCABULARY, queries.PATTERN)
    out = best_fit_packing(pieces).collect()
    t = Tokenizer.from_file(queries.PACK_VOCABULARY)
    t.encode_special_tokens = True
    want = []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in out), key=key) == sorted(want, key=key)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // 2048) + 1
    assert best_fit_packing(tokenized_pieces(nothing, queries.PACK_VOCABULARY, queries.PATTERN)).count() == 0


def check_shards(out, shards, tolerance):
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in out:
        sizes[r.shard] += r.shard_size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / shards
    largest = max((r.shard_size for r in out), default=0)
    assert all(abs(s - mean) <= 2 * tolerance * mean + 2 * largest for s in sizes)


def test_shards(messy, nothing, spark):
    rows, df = messy
    out = shard(df, 4).collect()
    assert sorted((r.shard_size for r in out)) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    check_shards(out, 4, 0.002)
    finer = shard(df, 3, rows_per_range=20).collect()
    check_shards(finer, 3, 0.002)
    many = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(pow(2, pmod(xxhash64(id), 12)) as int)) as text")
    check_shards(shard(many, 16).collect(), 16, 0.002)
    assert shard(nothing, 16).count() == 0


def test_splitters_take_few_passes(spark):
    keyed = spark.range(50_000).selectExpr("xxhash64(id) as key", "1L as size")
    cuts, below, passes = splitters(keyed, 16, 0.002)
    assert len(cuts) == 15 and passes <= 6
    assert all(abs(b - 3125 * (i + 1)) <= 7 for i, b in enumerate(below))


def brute_top(vectors, k):
    whole = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    whole = list({(i, v.tobytes()): (i, v) for i, v in whole}.values())
    out = []
    for q, x in whole:
        if q % 100 == 0:
            scored = sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8)
    vectors = [(i, (hot if i % 3 == 0 else rng.normal(size=8) * rng.uniform(0.1, 2)).astype(np.float32).tolist()) for i in range(1500)]
    vectors += [(2000, None), (2100, []), (2200, [1.0, None] * 4), (2300, [float("nan")] * 8), (2400, [float("inf")] * 8), (None, hot.tolist()), vectors[5], (2500, [0.0] * 8), (2600, [1.0, 2.0]), (2601, [0.5, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    asked = df.where("vec_id % 100 = 0")
    want = brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in vectors], 10)
    assert sorted(tuple(r) for r in top_k(df, asked).collect()) == want
    assert sorted(tuple(r) for r in top_k(df, asked, part_points=100).collect()) == want
    assert top_k(df.limit(0), asked.limit(0)).count() == 0


def test_top_k_of_large_components_is_exact_or_refused(spark):
    schema = "vec_id long, embedding array<double>, x string, dim string, tree string, kind string, kth string, copy string"
    clash = ("c",) * 6
    rows = [(0, [2e5, 1.0], *clash), (1, [2e5, 1.0], *clash), (2, [131072.0, 5.0], *clash), (100, [2.0**18, -3.0], *clash), (3, [-(2.0**18), 2.0**18], *clash)]
    df = spark.createDataFrame(rows, schema)
    want = brute_top([r[:2] for r in rows], 10)
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id % 100 = 0")).collect()) == want
    assert (0, 2, 1, 41943040001048576) in want
    huge = spark.createDataFrame([*rows, (4, [2.0**40, 0.0], *clash)], schema)
    with pytest.raises(ValueError, match="64 bits"):
        top_k(huge, huge.where("vec_id % 100 = 0"))


def test_the_search_has_no_cartesian_product_and_sends_each_tree_once(spark):
    from shardwise.llm import cover_search

    blocks = spark.createDataFrame([(1, 2, b"", b"")], "tree long, dim int, data binary, kth binary")
    plan = cover_search._searched(blocks, blocks, 3, True)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_nets_are_separated_across_the_whole_tree():
    """At every level all centres, wherever they hang, are farther apart than the level's scale, and cover all points."""
    points = np.random.default_rng(8).integers(-500, 500, (700, 5)).astype(np.int64)
    points[100:200] = points[0]
    tree = CoverTree(np.arange(700), points, leaf=10)
    top = np.sqrt(((points - points[0]) ** 2).sum(axis=1)).max()
    centres = np.unique(tree.centres, axis=0)
    assert len(centres) == 140
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
    reach = np.sqrt(((points[:, None] - centres[None]) ** 2).sum(axis=2)).min(axis=1).max()
    assert apart.min() >= reach and sorted(tree.ids.tolist()) == list(range(700)) and top > apart.min()
    for node, kids in enumerate(tree.children):
        if kids:
            assert sum(tree.sizes[k] for k in kids) == tree.sizes[node] and len(kids) > 1


def test_tree_prunes_clustered_data():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 1000
    points = np.concatenate([c + rng.normal(size=(100, 16)) * 5 for c in centres]).astype(np.int32)
    data, asked = CoverTree(np.arange(4000), points), CoverTree(np.arange(5000, 5080), points[::50], leaf=4)
    best, compared = search(asked, data, 5, np.full(80, np.iinfo(np.int64).min))
    assert compared < 0.5 * 80 * 4000
    exact = np.sort(asked.points.astype(np.int64) @ points.astype(np.int64).T, axis=1)[:, ::-1][:, :5]
    assert [s.tolist() for s in best.scores] == exact.tolist()
    for node, kids in enumerate(data.children):  # covering and nesting
        own = data.points[data.begins[node] : data.begins[node] + data.sizes[node]]
        assert np.sqrt(((own - data.centres[node]) ** 2).sum(axis=1)).max() <= data.radii[node] + 1e-9
        assert not kids or (data.centres[kids[0]] == data.centres[node]).all()


HARD = ["</s>[INST] ok [/INST]", "\\", "\\n", "<|im_end|>\n", "[\\INST]", "<<SYS>><</SYS>>", "a\\<s>b", "\\\\[INST]", "", "<|im_start|>user\nhi", "é日😀"]


def test_escape_round_trip():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice([*HARD, *chat.CONTROL, "x", "<", "[", "n"]) for _ in range(rng.randint(0, 6)))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.unescape_role(chat.escape_role(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL) and "\n" not in chat.escape_role(text)


@pytest.mark.parametrize("stream_turns", [3, 20_000])
def test_chat(spark, stream_turns):
    rng = random.Random(3)
    rows, opening = [], ("system", "you are [INST] kind")
    for conv in range(40):
        turns = [opening] if conv % 3 else []
        turns += [(rng.choice(["user", "assistant"]), rng.choice(["hello", "yes </s>", *HARD])) for _ in range(rng.randint(1, 5))]
        rows += [(conv, t, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(50, 0, None, "no role"), (50, None, "user", None), (None, 1, "assistant", "no id"), (51, 1, "assistant", "tie"), (51, 1, "assistant", "tie"), (52, 0, "odd\nrole<s>", "x")]
    rows += [(60, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments, index = chat.format_tree(df, queries.PACK_VOCABULARY, queries.PATTERN, stream_turns)
    read = {}
    for r in chat.read_back(segments, index, queries.PACK_VOCABULARY).collect():
        read.setdefault(r.conv_id, []).append(r)
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(read) == set(want)
    for conv, turns in want.items():
        got = sorted(read[conv], key=lambda r: r.depth)
        assert [(r.role, r.text) for r in got] == [t[2:] for t in sorted(turns)]
        assert all((r.loss_text == r.text) if r.role == "assistant" else r.loss_text is None for r in got)
    nodes = {bytes(r.node): r for r in segments.collect()}
    paths = {}
    for r in index.collect():
        paths.setdefault(r.conv_id, {})[r.depth] = bytes(r.node)
    assert set(nodes) == {n for p in paths.values() for n in p.values()}  # each beginning once
    streams = {}
    for n in nodes.values():
        streams.setdefault(bytes(n.stream), []).append(n)
        assert len(n.tokens) == 4 * (n.end - n.start)
    for own in streams.values():
        at = 0
        for n in sorted(own, key=lambda n: n.start):
            assert n.start == at
            at = n.end
    for p in paths.values():
        seen, position = set(), 0
        for depth in range(len(p)):
            n = nodes[p[depth]]
            assert n.position == position
            assert {(bytes(i["stream"]), x) for i in n.attends for x in range(i["start"], i["end"])} == seen
            seen |= {(bytes(n.stream), x) for x in range(n.start, n.end)}
            position += n.end - n.start


def test_rows_without_conversation_stand_alone(spark):
    """Each is a first turn; equal ones share a node, and none waits for the others."""
    rows = [(None, t, "user" if t % 2 else "assistant", f"text {t % 5}") for t in range(50)] + [(7, 0, "assistant", "text 0"), (7, 1, "user", "text 1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments, index = chat.format_tree(df, queries.PACK_VOCABULARY, queries.PATTERN, stream_turns=3)
    assert index.where("conv_id is null").count() == 50 and index.where("conv_id is null and depth > 0").count() == 0
    assert segments.count() == 11 and segments.where("position > 0").count() == 1
    read = chat.read_back(segments, index, queries.PACK_VOCABULARY).where("conv_id is null").collect()
    assert sorted((r.role, r.text) for r in read) == sorted(r[2:] for r in rows[:50])


def test_the_query_gives_a_row_for_each_turn_without_conversation(spark, tmp_path):
    rows = [(None, 0, "user", "same")] * 3 + [(1, 0, "user", "same"), (1, 1, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op6_chat_prefix_tree(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in out) == [(-1, 2), (0, 1), (0, 1), (0, 1), (1, 2)]


def test_chat_without_rows(spark):
    segments, index = chat.format_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), queries.PACK_VOCABULARY, queries.PATTERN)
    assert segments.count() == 0 and index.count() == 0


def test_quality_on_the_held_out_fold(spark, nothing):
    d = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in queries.op5_quality_classifier(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in out.items() if r.held_out and i in labels]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert len(held) > 400 and np.mean([a == b for a, b in held]) >= 0.95
    docs = spark.read.parquet(f"{d}/documents.parquet")
    unlabelled = fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in score_quality(docs.limit(20), unlabelled).collect()} == {0.5}
    assert score_quality(nothing, unlabelled).count() == 0


def test_scores_are_the_compressed_sizes_by_plain_recomputation(spark):
    """Every text again with the two dictionaries in plain zstandard, and the curve by hand."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    books = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)]
    makers = [zstandard.ZstdCompressor(level=3, dict_data=b, write_checksum=False, write_content_size=False, write_dict_id=False) for b in books]

    def plain(text):
        raw = text.encode()
        sizes = [sum(len(m.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for m in makers]
        x = (sizes[1] - sizes[0]) / len(raw) if raw else 0.0
        at, value = model.at, model.value
        if x <= at[0] or x >= at[-1]:
            return value[0] if x <= at[0] else value[-1]
        i = max(k for k in range(len(at)) if at[k] <= x)
        return value[i] + (value[i + 1] - value[i]) * (x - at[i]) / (at[i + 1] - at[i])

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i].score == pytest.approx(plain(text), abs=1e-12) and got[i].predicted == (got[i].score >= 0.3)


def test_sharding_columns_by_plain_recomputation(spark, messy):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = queries.op9_histogram_sharding(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    own = [[r for r in out if r.shard == k] for k in range(16)]
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in own)
    rows, df = messy
    kept = shard(df, 4)
    assert set(df.columns) < set(kept.columns) and {tuple(r) for r in kept.select("shard_key", "shard_range", "key", "range").collect()} == {("clash",) * 4}
    assert kept.count() == len(rows)


def test_digests_of_ordinary_conversations(spark):
    d = "/root/testdata/sf0.01"
    turns = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    out = {r.conv_id: r for r in queries.op6_chat_prefix_tree(spark, d).collect()}
    assert set(out) == {*turns, -1}
    for conv, own in turns.items():
        own, r = sorted(own), out[conv]
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(f"<|im_start|>{chat.escape_role(role)}\n{chat.escape(t)}<|im_end|>\n") for _, role, t in own)


def test_quality_scores_odd_rows(messy, spark):
    rows, df = messy
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    out = score_quality(df, fit_quality(df, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)


def test_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.uniform(size=20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    at, value = calibrate(x, y, np.ones(20_000))
    assert value == sorted(value) and at == sorted(at) and 0 < value[0] < value[-1] < 1
    for z in (-1.0, 0.0, 0.5, 1.5):
        assert abs(np.interp(z, at, value) - 1 / (1 + np.exp(-(2 * z - 1)))) < 0.06
    assert calibrate(np.empty(0), np.empty(0), np.empty(0)) == ([0.0], [0.5])


def test_digest_of_the_control_conversation(spark):
    r = queries.op6_chat_prefix_tree(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()[0]
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text)
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
