"""Headline queries, timed on local[$BENCH_CPUS]; prints one JSON line.

Queries of up to REPEAT_BELOW seconds count with the median of three runs, longer ones with their only run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from shardwise.catalog import inputs  # noqa: E402
from shardwise.catalog.queries import QUERIES  # noqa: E402
from shardwise.config import ForestConfig, LinearConfig  # noqa: E402
from shardwise.functions.hashing import hash_order, normal  # noqa: E402
from shardwise.operators import evaluate, profile, sampling, scaling  # noqa: E402
from shardwise.plans.forest_job import run_forest  # noqa: E402
from shardwise.plans.linear_job import run_linear  # noqa: E402
from shardwise.session import local_session  # noqa: E402
from shardwise.sources.scratch import scratch_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT_BELOW = 8.0
CACHE: list[str] = []
SHAPE: list[str] = []


def logistic_10_rounds(spark):
    """The published configuration: 25 clients, 10 rounds, l2, 20 local epochs, undersampling 1.0."""
    run = run_linear(inputs.events(spark, SF_DIR), inputs.FEATURES, LinearConfig(), inputs.KEY)
    return run.round_metrics


def logistic_10_rounds_cached(spark):
    """The same run over partitions an earlier run has prepared: training and evaluation only."""
    run = run_linear(inputs.events(spark, SF_DIR), inputs.FEATURES, LinearConfig(), inputs.KEY, cache_dir=CACHE[0], source=SF_DIR)
    return run.round_metrics


def logistic_10_rounds_wide(spark):
    """The same on 64 features (the embeddings)."""
    names = [f"x{i}" for i in range(64)]
    df = inputs.vectors(spark, SF_DIR).select("vec_id", "label", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    return run_linear(df, names, LinearConfig(clients=10), "vec_id").round_metrics


def baseline_shape(spark):
    """Rows of the published run's shape, written before the clock runs: 133,750 with 115 features, one in five positive."""
    noise = F.transform(F.sequence(F.lit(0), F.lit(114)), lambda i: normal(hash_order(1, "bench", "id", i)))
    rows = spark.range(133_750).withColumn("x", noise).withColumn("label", (F.col("x")[0] + F.col("x")[1] > 1.2).cast("int"))
    path = scratch_dir(spark, "bench-shape")
    rows.select("id", "label", *[F.col("x")[i].alias(f"f{i}") for i in range(115)]).write.parquet(path)
    return path


def logistic_baseline_shape(spark):
    """The published configuration on rows of the published shape."""
    return run_linear(spark.read.parquet(SHAPE[0]), [f"f{i}" for i in range(115)], LinearConfig(), "id").round_metrics


def svm_10_rounds(spark):
    return run_linear(inputs.events(spark, SF_DIR), inputs.FEATURES, LinearConfig.svm(), inputs.KEY).round_metrics


def forest_2_rounds(spark):
    return run_forest(inputs.events(spark, SF_DIR), inputs.FEATURES, ForestConfig(rounds=2, clients=4), inputs.KEY).round_metrics


def lineitem_scaler(spark):
    return scaling.fit_scaler(inputs.lineitems(spark, SF_DIR), ["quantity", "price", "discount", "tax"])


def lineitem_profile(spark):
    return profile.dataset_profile(inputs.lineitems(spark, SF_DIR), ["l_linestatus"], "label", ["quantity", "price"])


def lineitem_metrics(spark):
    price = F.col("price")
    scored = inputs.lineitems(spark, SF_DIR).withColumns(
        {"decision": (price - 40000.0) / 20000.0, "proba": price / (price + 40000.0), "pred": (price > 40000.0).cast("int")}
    )
    return evaluate.metrics(scored, ["l_linestatus"])


def orders_split(spark):
    return sampling.random_split(inputs.orders(spark, SF_DIR), ["order_id"], 0.2, 42).groupBy("split").count()


def _registered(name):
    return lambda spark: QUERIES[name](spark, SF_DIR)


BENCH = {
    "logistic_10_rounds": logistic_10_rounds,
    "logistic_10_rounds_cached": logistic_10_rounds_cached,
    "logistic_10_rounds_wide": logistic_10_rounds_wide,
    "logistic_baseline_shape": logistic_baseline_shape,
    "svm_10_rounds": svm_10_rounds,
    "forest_2_rounds": forest_2_rounds,
    "lineitem_scaler": lineitem_scaler,
    "lineitem_profile": lineitem_profile,
    "lineitem_metrics": lineitem_metrics,
    "orders_split": orders_split,
    **{name: _registered(name) for name in ("tree_fit", "iid_partition", "stratified_split", "oversample", "evaluate_clients", "tree_scores", "logistic_epoch")},
}


try:  # the training-data operators, where that subpackage is there
    from shardwise.llm.queries import QUERIES as OPERATORS
except ImportError:
    OPERATORS = {}
BENCH |= {name: lambda spark, q=q: q(spark, SF_DIR) for name, q in OPERATORS.items()}


def main() -> None:
    spark = local_session("shardwise-bench", CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and Python's workers, and prepare the cached run, before the clock runs.
    CACHE.append(scratch_dir(spark, "bench-cache"))
    warm = LinearConfig(rounds=3)
    run_linear(inputs.events(spark, SF_DIR), inputs.FEATURES, warm, inputs.KEY, cache_dir=CACHE[0], source=SF_DIR).round_metrics.collect()
    names = sys.argv[1:] or list(BENCH)
    if "logistic_baseline_shape" in names:
        SHAPE.append(baseline_shape(spark))
    seconds = {}
    for name in names:
        runs: list[float] = []
        while len(runs) < 3 and (not runs or runs[0] <= REPEAT_BELOW):
            begin = time.perf_counter()
            BENCH[name](spark).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(median(runs), 3)
    line = {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
