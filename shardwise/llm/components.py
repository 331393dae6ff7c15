"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.store import written


def components(links: DataFrame, name: str) -> DataFrame:
    """Links (a, b) to rows (node, component), where component is the smallest node that links reach.

    Each round joins every node to its neighbour of smallest hash, then renames the ends of the links and
    forgets those inside one node: hashes are as good as random, so chains shrink by a factor each round.
    Every round is a written table. Nodes without a link to another node do not appear.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    hooks: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
        hook = both.groupBy("a").agg(F.min(ranked("b")).alias("best"))
        hook = hook.select(F.col("a").alias("node"), F.least(ranked("a"), F.col("best"))["node"].alias("to"))
        hook = written(hook, f"{name}-hooks")
        hooks.append(hook)
        for end in ("a", "b"):
            links = links.join(hook.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = hooks[0]
    for hook in hooks[1:]:
        labels = labels.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    labels = written(labels, f"{name}-labels")
    least = labels.groupBy("to").agg(F.min("node").alias("component"))
    return labels.join(least, "to").select("node", "component")
