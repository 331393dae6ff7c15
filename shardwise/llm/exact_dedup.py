"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.llm.store import documents, utf8, written

PREFIX_CHARS = 64
#: Words of 64 bits in the largest survivor filter: 2**18 rows of 16 bytes, 4 MB.
FILTER_WORDS = 2**18


def normalised(text: str | Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"\x20{2,}[\x20\x09-\x0D]*|\x20?[\x09-\x0D][\x20\x09-\x0D]*", " ")


def _slot(key: Column, words: int) -> tuple[Column, Column]:
    return F.pmod(key, F.lit(words)), F.pmod(F.shiftrightunsigned(key, 40), F.lit(64)).cast("int")


def _survivors(groups: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """A bit for the hash of each surviving group, as a table of words; a filter that lets all survivors through.

    The table has a row per 64 bits and at most FILTER_WORDS rows, whatever the number of groups. Where
    groups are many, it lets more rows through; they only cost a hash each, the grouping that follows is exact.
    """
    words = max(1024, min(FILTER_WORDS, groups.count()))
    word, bit = _slot(F.xxhash64(*keys), words)
    return groups.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), words


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: bool = True, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id (smallest doc_id of the same text), group_size, kept, sha256 (binary).

    1. Lengths: groups of one are unique. 2. Hash of the first characters, within lengths that repeat.
    3. SHA-256 of the whole text, only for documents whose length and prefix repeat. Between the steps the
    scan tests a bounded bit filter of the surviving groups, so texts never move and unique ones are not
    hashed. `digest_all` also gives unique texts their sha256 (else null).

    Null text counts as empty. Rows that repeat an id and its text are all reported with the same keep_id and
    count in group_size; kept is true where doc_id equals keep_id. Null ids give way to any other id; a
    group of null ids only has keep_id null and is kept. An empty table gives an empty table.
    """
    rows = documents(docs, id_col, text_col)
    rows = rows.withColumn("text", normalised("text")) if normalise else rows
    sized = written(rows.select(F.octet_length("text").alias("size"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix")), "exact-sizes")
    lengths = sized.groupBy("size").count().where("count > 1").select("size")
    lengths = written(lengths, "exact-lengths")
    by_length, words = _survivors(lengths, ["size"])
    word, bit = _slot(F.xxhash64("size"), words)
    maybe = sized.withColumn("word", word).join(F.broadcast(by_length), "word").where(F.getbit("bits", bit) == 1)
    prefixes = written(maybe.groupBy("size", "prefix").count().where("count > 1").select("size", "prefix"), "exact-prefixes")
    by_prefix, words = _survivors(prefixes, ["size", "prefix"])
    keyed = rows.withColumns({"size": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, PREFIX_CHARS))})
    word, bit = _slot(F.xxhash64("size", "prefix"), words)
    tested = keyed.withColumn("word", word).join(F.broadcast(by_prefix), "word", "left").withColumn("survives", F.coalesce(F.getbit("bits", bit) == 1, F.lit(False)))
    sha = F.unhex(F.sha2(utf8("text"), 256))
    full = written(tested.select("doc_id", "survives", (sha if digest_all else F.when(F.col("survives"), sha)).alias("sha256")), "exact-full")
    rest = full.where("survives")
    groups = rest.groupBy("sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = rest.join(groups, "sha256").select("doc_id", "keep_id", "group_size", "sha256")
    alone = full.where("not survives").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha256")
    return alone.unionByName(grouped).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
