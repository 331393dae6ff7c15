"""Observation, score, model and forest tables that Spark derives from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwise.operators.evaluate import metrics
from shardwise.operators.sampling import iid_partition
from shardwise.sources.observations import assemble, read_observations
from shardwise.sources.scratch import settle
from shardwise.sources.state import params_row

SEED = 42
CLIENTS = 10
KEY = "event_id"
FEATURES = ["value", "hour", "dow"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_observations(spark, f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event: is it an error?"""
    return table(spark, sf_dir, "events").select(
        KEY,
        F.col("value"),
        F.hour("ts").cast("double").alias("hour"),
        F.dayofweek("ts").cast("double").alias("dow"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order: is it finished?"""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("price"),
        F.month("o_orderdate").cast("double").alias("month"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order line: was it returned?"""
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide observation per embedding."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 3).cast("int").alias("label")
    )


def parted(spark: SparkSession, sf_dir: str, clients: int = CLIENTS) -> DataFrame:
    """Events dealt to clients."""
    return iid_partition(events(spark, sf_dir), [KEY], clients, SEED)


def fixed_score(df: DataFrame) -> DataFrame:
    """Events with a score that depends on the value only."""
    value = F.col("value")
    return df.withColumns(
        {"decision": (value - 50.0) / 50.0, "proba": value / (value + 50.0), "pred": ((value - 50.0) / 50.0 > 0).cast("int")}
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_score(parted(spark, sf_dir))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored by their price; the labels are balanced enough for binary averages."""
    price = F.col("price")
    return orders(spark, sf_dir).withColumns(
        {"decision": (price - 250000.0) / 100000.0, "proba": price / (price + 250000.0), "pred": (price > 250000.0).cast("int")}
    )


def centroid_params(parts: DataFrame, features: list[str]) -> DataFrame:
    """A linear model per client: the plane between its class means. Failed where a client has few positives."""
    rows = parts.withColumn("round", F.lit(1)).groupBy("round", "client_id")
    means = [
        F.avg(F.when(F.col("label") == k, F.col(c))).alias(f"{c}_{k}") for c in features for k in (0, 1)
    ]
    stats = rows.agg(F.count("*").alias("n_examples"), F.avg("label").alias("share"), *means)
    coef = {c: F.round(F.col(f"{c}_1") - F.col(f"{c}_0"), 9) for c in features}
    middle = F.lit(0.0)
    for c in features:
        middle = middle + coef[c] * (F.col(f"{c}_1") + F.col(f"{c}_0")) / 2.0
    status = F.when(F.col("share") < 0.2, "failed").otherwise("ok")
    return params_row(stats.withColumn("status", status), [coef[c] for c in features], F.round(-middle, 9))


def client_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_params(parted(spark, sf_dir), ["value", "hour"])


def client_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the fixed score per client and round, where the round is the hour of the event."""
    rows = scored(spark, sf_dir).withColumn("round", F.col("hour").cast("int") + 1)
    return metrics(rows, ["round", "client_id"])


def round_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with one row per hour, taken as rounds."""
    rows = fixed_score(events(spark, sf_dir)).withColumn("round", F.col("hour").cast("int") + 1)
    return metrics(rows, ["round"]).drop("n_examples")


# Shape of the threshold trees: tree, node, split feature (None for a leaf), children, and the
# path of (feature, goes left) from the root.
TREES = (
    (0, 0, 0, 1, 2, ()),
    (0, 1, 1, 3, 4, ((0, True),)),
    (0, 2, 2, 5, 6, ((0, False),)),
    (0, 3, None, -1, -1, ((0, True), (1, True))),
    (0, 4, None, -1, -1, ((0, True), (1, False))),
    (0, 5, None, -1, -1, ((0, False), (2, True))),
    (0, 6, None, -1, -1, ((0, False), (2, False))),
    (1, 0, 1, 1, 2, ()),
    (1, 1, None, -1, -1, ((1, True),)),
    (1, 2, None, -1, -1, ((1, False),)),
)


def _gini(zero: Column, one: Column) -> Column:
    n = zero + one
    return F.when(n > 0, 1.0 - (zero / n) * (zero / n) - (one / n) * (one / n)).otherwise(0.0)


def threshold_forest(parts: DataFrame) -> DataFrame:
    """Two small trees per client that split at the client's feature means, with its class counts as leaves."""
    means = settle(parts.groupBy("client_id").agg(*[F.round(F.avg(c), 6).alias(f"t{i}") for i, c in enumerate(FEATURES)]))
    rows = parts.join(means.side(), "client_id")

    def inside(path) -> Column:
        reached = F.lit(True)
        for feature, left in path:
            low = F.col(FEATURES[feature]) <= F.col(f"t{feature}")
            reached = reached & (low if left else ~low)
        return reached

    counted = [
        F.count_if(inside(path) & (F.col("label") == k)).alias(f"c{k}_{t}_{node}")
        for t, node, _, _, _, path in TREES
        for k in (0, 1)
    ]
    totals = rows.groupBy("client_id", "t0", "t1", "t2").agg(*counted)

    def count(t: int, node: int, k: int) -> Column:
        return F.col(f"c{k}_{t}_{node}").cast("double")

    entries = []
    for t, node, feature, left, right, _ in TREES:
        zero, one = count(t, node, 0), count(t, node, 1)
        gain = F.lit(-1.0)
        if feature is not None:
            below = [(count(t, child, 0), count(t, child, 1)) for child in (left, right)]
            gain = _gini(zero, one)
            for z, o in below:
                gain = gain - F.when(zero + one > 0, (z + o) / (zero + one)).otherwise(0.0) * _gini(z, o)
        entries.append(F.struct(
            F.lit(t).alias("tree_id"), F.lit(node).alias("node_id"),
            F.lit(-1 if feature is None else feature).alias("feature"),
            (F.lit(None).cast("double") if feature is None else F.col(f"t{feature}")).alias("threshold"),
            F.lit(left).alias("left"), F.lit(right).alias("right"),
            F.array(zero, one).alias("counts"), gain.alias("gain"), (zero + one).cast("bigint").alias("n"),
        ))
    long = totals.select("client_id", F.explode(F.array(*entries)).alias("e"))
    return long.select(F.lit(1).alias("round"), "client_id", "e.*")


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold trees of all clients, evaluated once: clients x 10 rows."""
    return settle(threshold_forest(parted(spark, sf_dir))).df


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all clients with their feature array."""
    return assemble(parted(spark, sf_dir), FEATURES).select(KEY, "client_id", "label", "x")
