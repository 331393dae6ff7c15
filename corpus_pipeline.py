"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwise.llm import jaccard_join, line_dedup, packing, quality, suffix_dedup
from shardwise.llm.store import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _columns(df: DataFrame, docs: DataFrame, text: Column, other: Callable[[str], Column]) -> DataFrame:
    """The columns of `docs`: the new text, n_chars that follows it, the others as they were."""
    new: dict[str, Column] = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return df.select(*[new[c].alias(c) if c in new else other(c).alias(c) for c in docs.columns])


def _rewritten(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """`docs` with the texts of (doc_id, text_hash of the old text, text)."""

    def keyed(df: DataFrame, old: Column, *more: Column) -> DataFrame:
        return df.select(F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), old.alias("k_text"), *more)

    keys = ["k_id", "k_null", "k_text"]  # never null: one exchange serves both the grouping and the join
    rest = keyed(docs, F.xxhash64(F.coalesce("text", F.lit(""))), F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"))
    new = keyed(texts, F.col("text_hash"), F.col("text").alias("new_text")).groupBy(*keys).agg(F.max("new_text").alias("new_text"))
    return _columns(rest.join(new, keys), docs, F.col("new_text"), lambda c: F.col("row")[c])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; a table without usable labels scores all 0.5.

    Null, empty and very long texts, null ids, ties and repeated rows are scored and kept or dropped like any other row.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, keep=docs.columns)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines of ten or more sites stay in their first document only."""
    return _rewritten(docs, line_dedup.line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by 0.8 of their five-word shingles: the one of smallest id.

    Rows that repeat an id are one document; of rows equal in id and text one stays. Rows without id all stay.
    """
    out = jaccard_join.jaccard_components(docs, words=5, percent=80)
    stay = out.where("doc_id is not null").select(F.col("doc_id").alias("stay_id"), "component_id").where("stay_id = component_id").select("stay_id").distinct()
    kept = docs.join(stay, docs["doc_id"] == stay["stay_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without strings of 50 bytes or more that an earlier document has; characters stay whole."""
    out = suffix_dedup.suffix_dedup(docs, as_text=True, carry=[c for c in docs.columns if c != "text"])
    return _columns(out, docs, F.col("kept"), lambda c: F.col("row")[c])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with the training sequence and offset each goes to.

    A null or empty text is one piece of the end id; very long ones give several; rows that share or lack an id, and repeated
    rows, are packed each for themselves.
    """
    pieces = packing.tokenized_pieces(docs, VOCABULARY, public_tokenizers.PATTERN)
    return packing.best_fit_packing(pieces.withColumn("ids_crc32", F.crc32("ids")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", boilerplate_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("best_fit_packing", pack_sequences),
]

#: Compressed sizes, connected components and packing have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again by the next.

    Every column comes through up to the last stage, whatever its name. Nulls, empty and very long texts, ties and repeated
    rows are as each stage says; an empty table gives no row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
