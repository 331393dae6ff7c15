"""Boilerplate lines across sites, found with HyperLogLog sketches. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.store import written
from shardwise.sources.scratch import settle

MIN_SITES = 10
LG_K = 10


def line_spread(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Lines (h1, h2, site, doc_id) to the boilerplate among them: h1, h2, first_doc.

    One sketch of sites per line hash, merged by the aggregation itself. A line whose estimate is farther from
    the threshold than three standard errors is decided by it; nearer ones get their distinct sites counted.
    """
    margin = max(1.0, math.ceil(3 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    keys = ["h1", "h2"]
    sketches = lines.groupBy(*keys).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"))
    sketches = sketches.select(*keys, "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin)
    sketches = settle(sketches).df
    near = sketches.where(F.col("sites") <= min_sites + margin)
    counted = lines.join(near.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count_distinct("site").alias("exact"))
    exact = near.join(counted.where(F.col("exact") >= min_sites), keys).select(*keys, "first_doc")
    return sketches.where(F.col("sites") > min_sites + margin).select(*keys, "first_doc").unionByName(exact)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with cross-site boilerplate lines taken out: doc_id, text, n_lines, n_removed, text_hash.

    A line (text between \\n, without spaces at its ends) that stands on `min_sites` distinct sites or more is
    boilerplate; it stays in the document of smallest id that has it and goes from all others, so a copied
    document keeps its lines once. Blank lines always stay. Texts without a removed line are unchanged.
    text_hash is the hash of the text that came in.

    Null text counts as empty; a null site counts as no site; null ids give way to other ids as first document.
    Rows that repeat an id and its text are all returned, alike. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(site_col).cast("string").alias("site"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    lines = rows.select("doc_id", "text_hash", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    lines = written(lines.select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "line-hashes")
    spread = settle(line_spread(lines, min_sites)).df
    gone = lines.join(spread, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set("pos").alias("gone"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    every = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "gone")
    cut = F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n")
    removed = F.coalesce(F.size("gone"), F.lit(0))
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("text"),
        F.size(every).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(removed).cast("long").alias("n_removed"),
        "text_hash",
    )
