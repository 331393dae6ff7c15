"""One registered query for each operator of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwise.llm import bpe, chat, conversation_trie, cover_search, exact_dedup, hard_negatives, jaccard_join, line_dedup, packing, quality, sharding, substring_dedup, suffix_dedup
from shardwise.llm.store import utf8

PACK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines of ten or more sites: counts and the digest of what is left."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(utf8("text"), 256).alias("kept_sha256"))


def op2_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return cover_search.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back from the tokens."""
    extra = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", extra), (-1, 1, "assistant", extra)], "conv_id long, turn long, role string, text string"))
    segments, index = chat.format_tree(rows, PACK_VOCABULARY, PATTERN)
    turns = chat.read_back(segments, index, PACK_VOCABULARY)
    turns = turns.withColumn("single", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))  # conversations of one row
    whole = turns.groupBy("conv_id", "single").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text", "loss_text", "chars"))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["loss_text"], F.lit(""))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(utf8(said), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(utf8(loss), 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["chars"]).alias("formatted_chars"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), PACK_VOCABULARY, PATTERN)
    return packing.best_fit_packing(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs.withColumn("text_crc32", sharding.crc32_of("text")), 16)
    return out.select("doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(utf8("kept"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as anchor; every seventh label is moved on by one, so that labels and vectors disagree."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.pmod("vec_id", F.lit(50)) == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_cover_tree_search,
        op3_exact_dedup,
        op4_suffix_dedup,
        op5_quality_classifier,
        op6_chat_prefix_tree,
        op7_best_fit_packing,
        op8_ngram_jaccard_join,
        op9_histogram_sharding,
        op10_rank_queue_bpe,
        op11_conversation_trie,
        op12_substring_dedup,
        op13_hard_negatives,
    )
}

SQL = {
    "op1_line_dedup": """
WITH docs AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
spread AS (
    SELECT trim(line) AS line, min(doc_id) AS first_doc FROM lines WHERE trim(line) <> ''
    GROUP BY trim(line) HAVING count(DISTINCT source) >= 10),
kept AS (
    SELECT l.doc_id, l.line, l.pos, s.line IS NOT NULL AND l.doc_id IS DISTINCT FROM s.first_doc AS gone
    FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id""",
    "op2_cover_tree_search": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_conversation_trie": """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
    SELECT conv_id, count(*) AS n,
        xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
            lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 6 AS h
    FROM t GROUP BY conv_id),
info AS (
    SELECT s.conv_id, s.h, s.conv_id - s.conv_id % 100 AS base, least(s.h, coalesce(b.n, 0)) AS g
    FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 100),
r AS (
    SELECT i.conv_id, g + pos - h + 1 AS d, role, text FROM t JOIN info i ON t.conv_id = i.conv_id WHERE pos >= h
    UNION ALL SELECT i.conv_id, pos + 1, role, text FROM info i JOIN t ON t.conv_id = i.base WHERE pos < h
    UNION ALL SELECT conv_id, 0, '', '' FROM info),
named AS (
    SELECT conv_id, d, length(text) AS chars, max(d) OVER (PARTITION BY conv_id) AS len,
        md5(string_agg(md5(role || chr(10) || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM r),
p AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM named),
nodes AS (
    SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len), '')) AS ends_sha256
    FROM p GROUP BY node),
below AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
own AS (
    SELECT n.node, n.conv_id, (n_convs - 1) * chars AS saved, CASE WHEN b.n_children IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes n LEFT JOIN below b ON n.node = b.node),
sums AS (
    SELECT p.node, sum(coalesce(saved, 0)) OVER w AS saved, sum(coalesce(leaf, 0)) OVER w AS leaves
    FROM p LEFT JOIN own ON p.node = own.node AND p.conv_id = own.conv_id WINDOW w AS (PARTITION BY p.conv_id ORDER BY d DESC)),
totals AS (SELECT node, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaves) AS BIGINT) AS n_leaves FROM sums GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON n.node = t.node LEFT JOIN below b ON n.node = b.node LEFT JOIN nodes u ON n.parent = u.node""",
    "op12_substring_dedup": r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
windows AS (
    SELECT *, CASE WHEN i + 20 <= n THEN md5(string_agg(word, ' ') OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) END AS k FROM words),
late AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM windows),
cover AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM late)
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id GROUP BY d.doc_id""",
    "op13_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
}
