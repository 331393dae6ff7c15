"""Sequential stochastic gradient descent in hash order, one learner per client.

The order of rows is the state's order, so a client cannot be trained in parallel with itself.
A client that fits one task runs all its epochs there. A larger one is cut into chunks of its
order and the weights are relayed from chunk to chunk: the same arithmetic, never more than one
chunk of a client in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.functions.hashing import hash_order
from shardwise.functions.linear import penalty_parts
from shardwise.functions.schedules import ETA_DECAY, ETA_START
from shardwise.operators.linear import CLIENT_ROWS, Learner, client_stats, starting_state
from shardwise.operators.ranking import cutoffs, position_key
from shardwise.sources.scratch import Settled, scratch_dir, settle
from shardwise.sources.state import PARAMS_SCHEMA

CHUNK_VALUES = 10_000_000
# Fixed value: epochs without a better loss before a learner stops.
PATIENCE = 5
ORDER = "sgd"

_STATE = (
    "client_id INT, n_examples BIGINT, status STRING, coef ARRAY<DOUBLE>, intercept DOUBLE, c0 DOUBLE, c1 DOUBLE, "
    "t DOUBLE, u DOUBLE, q ARRAY<DOUBLE>, loss_sum DOUBLE, best DOUBLE, stale INT, done BOOLEAN"
)


def local_sgd(
    train: DataFrame,
    params: DataFrame | Settled,
    made: Learner,
    key: list[str],
    seed: int,
    epochs: int | None = None,
    stats: Settled | None = None,
    schedule: str = "optimal",
    round_no: int | None = None,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """Fit every client of `train` (client_id, label, x, key) row by row; the result is a params table.

    `schedule` is "optimal" (step 1 / (alpha (t0 + t))) or "round" (the per-round step).
    """
    epochs = made.epochs if epochs is None else epochs
    begin = starting_state(stats or settle(client_stats(train, made), limit=CLIENT_ROWS), params).df.select(
        "client_id", F.col("n").alias("n_examples"), "status", "coef", "intercept", "c0", "c1",
        F.lit(1.0).alias("t"), F.lit(0.0).alias("u"), F.transform("coef", lambda _: F.lit(0.0)).alias("q"),
        F.lit(0.0).alias("loss_sum"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("stale"), F.lit(False).alias("done"),
    )
    state = settle(begin, limit=CLIENT_ROWS)
    first = state.df.select(F.size("coef")).first()
    width = first[0] if first else 0
    chunk_rows = max(1, chunk_values // (width + 1))
    largest = state.largest("n_examples")
    step = _step_rule(made, schedule, round_no)
    if largest <= chunk_rows:
        ordered = train.select("client_id", "label", "x", *_order_columns(key, seed))
        final = _relay(ordered, state, made, step, epochs)
    else:
        final = _chunked(train, state, made, step, epochs, key, seed, chunk_rows, largest)
    finite = F.forall("coef", lambda w: ~F.isnan(w) & (F.abs(w) < float("inf")))
    return final.select(
        F.lit(round_no).cast("int").alias("round"), "client_id", "n_examples",
        F.when((F.col("status") == "ok") & finite, "ok").otherwise("failed").alias("status"),
        "coef", F.when(F.lit(made.fit_intercept), F.col("intercept")).alias("intercept"),
    ).select(*PARAMS_SCHEMA.names)


def _step_rule(made: Learner, schedule: str, round_no: int | None) -> tuple[float, float]:
    """(constant step or 0, shift t0 of the decaying step)."""
    if schedule == "round":
        return ETA_START / (1.0 + ETA_DECAY * (round_no or 0)), 0.0
    alpha = made.alpha or 1e-4
    typical = math.sqrt(1.0 / math.sqrt(alpha))
    slope = {"hinge": 1.0, "modified_huber": 4.0}.get(made.loss, 1.0 / (1.0 + math.exp(-typical)))
    first = typical / max(1.0, slope)
    return 0.0, 1.0 / (first * alpha)


def _order_columns(key: list[str], seed: int) -> list[Column]:
    return [hash_order(seed, ORDER, *key).alias("order_0"), *[F.col(k).alias(f"order_{i}") for i, k in enumerate(key, 1)]]


def chunk_numbers(train: DataFrame, key: list[str], seed: int, chunk_rows: int, most: int) -> DataFrame:
    """Add `chunk`: how many of the client's cutoffs, one every `chunk_rows` ranks of its order, lie before the row.

    Counting the cutoffs reads keys only, and a row finds its chunk where it is: no exchange of rows.
    """

    def ranks(sizes: DataFrame) -> DataFrame:
        some = sizes.where(F.col("n") > chunk_rows)
        return some.select("client_id", F.explode(F.sequence(F.lit(chunk_rows).cast("long"), F.col("n") - 1, F.lit(chunk_rows).cast("long"))).alias("r"))

    found = cutoffs(train.select("client_id", *key), ["client_id"], key, seed, ORDER, ranks, most)
    lists = found.df.groupBy("client_id").agg(F.collect_list("cut").alias("cuts"))
    joined = train.join(F.broadcast(lists) if found.small else lists, "client_id", "left")
    before = F.size(F.filter("cuts", lambda c: c < position_key(seed, ORDER, key)))
    return joined.withColumn("chunk", F.when(F.col("cuts").isNull(), 0).otherwise(before).cast("int")).drop("cuts")


def _chunked(train, state, made, step, epochs, key, seed, chunk_rows, largest) -> DataFrame:
    last = -(-largest // chunk_rows)
    numbered_rows = chunk_numbers(train.select("client_id", "label", "x", *key), key, seed, chunk_rows, last)
    path = scratch_dir(train.sparkSession, "sgd")
    placed = numbered_rows.select("client_id", "label", "x", *_order_columns(key, seed), "chunk")
    placed.repartition("chunk", "client_id").write.partitionBy("chunk").parquet(path)
    chunks = train.sparkSession.read.schema(placed.schema).parquet(path)
    for _ in range(epochs):
        for c in range(last):
            # Only clients that reach this chunk take part; the others keep their state.
            part = chunks.where(F.col("chunk") == c).drop("chunk")
            stepped = _relay(part, state, made, step, 1, finish=False)
            kept = state.df.join(stepped.select("client_id"), "client_id", "left_anti")
            state = settle(stepped.unionByName(kept), limit=CLIENT_ROWS)
        state = settle(_end_epoch(state.df, made), limit=CLIENT_ROWS)
        if state.df.where(~F.col("done") & (F.col("status") == "ok")).limit(1).count() == 0:
            break
    return state.df


def _end_epoch(state: DataFrame, made: Learner) -> DataFrame:
    """Column form of the stopping rule inside `_relay`."""
    tol = F.lit(made.tol if made.tol is not None else float("-inf")).cast("double")
    worse = F.col("best").isNotNull() & (F.col("loss_sum") > F.col("best") - tol * F.col("n_examples"))
    worse = worse & F.lit(made.tol is not None)
    stale = F.when(worse, F.col("stale") + 1).otherwise(0)
    best = F.least(F.coalesce("best", F.lit(float("inf"))), F.col("loss_sum"))
    return state.withColumns({"stale": stale, "best": best, "done": F.col("done") | (stale >= PATIENCE), "loss_sum": F.lit(0.0)})


def _relay(rows: DataFrame, state: Settled, made: Learner, step: tuple[float, float], epochs: int, finish: bool = True) -> DataFrame:
    """Run the given rows of each client through its learner, in order, `epochs` times.

    States of few clients go with the task; those of many are brought to their clients' rows.
    """
    starts = {r["client_id"]: r for r in state.records()} if state.small else None
    names = state.df.columns
    loss, fit_intercept, tol, patience = made.loss, made.fit_intercept, made.tol, PATIENCE
    alpha = made.alpha or 1e-4
    l1, l2 = penalty_parts(made.penalty, made.l1_ratio)
    constant, shift = step

    def row_loss(y, f):
        z = (2.0 * y - 1.0) * f
        if loss == "hinge":
            return max(0.0, 1.0 - z)
        if loss == "modified_huber":
            return 0.0 if z >= 1.0 else (1.0 - z) ** 2 if z >= -1.0 else -4.0 * z
        return math.log1p(math.exp(-z)) if z > -18.0 else -z

    def row_slope(y, f):
        sign = 2.0 * y - 1.0
        z = sign * f
        if loss == "hinge":
            return -sign if z <= 1.0 else 0.0
        if loss == "modified_huber":
            return 0.0 if z >= 1.0 else -2.0 * sign * (1.0 - z) if z >= -1.0 else -4.0 * sign
        return -sign / (1.0 + math.exp(min(z, 700.0)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return fit(dict(starts[key[0].as_py()]), table)

    def run_beside(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return target.empty_table()
        (s,) = own.to_pylist()
        return fit(s, table)

    def fit(s: dict, table: pa.Table) -> pa.Table:
        if s["status"] == "ok" and not s["done"]:
            ordered = table.sort_by([(c, "ascending") for c in table.column_names if c.startswith("order_")])
            y = ordered.column("label").to_numpy().astype(float)
            w, q = np.array(s["coef"], dtype=float), np.array(s["q"], dtype=float)
            x = ordered.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(w))
            b, t, u = float(s["intercept"] or 0.0), s["t"], s["u"]
            class_weight = np.where(y == 1, s["c1"], s["c0"])
            for _ in range(epochs):
                for i in range(len(y)):
                    f = float(w @ x[i]) + b
                    eta = constant or 1.0 / (alpha * (shift + t - 1.0))
                    s["loss_sum"] += row_loss(y[i], f)
                    move = -eta * class_weight[i] * min(max(row_slope(y[i], f), -1e12), 1e12)
                    if l2:
                        w *= max(0.0, 1.0 - l2 * eta * alpha)
                    if move:
                        w += move * x[i]
                        b += move if fit_intercept else 0.0
                    if l1:
                        # Cumulative l1: each weight owes the total penalty so far minus what it has paid.
                        u += l1 * eta * alpha
                        before = w.copy()
                        w = np.where(w > 0, np.maximum(0.0, w - (u + q)), np.where(w < 0, np.minimum(0.0, w + (u - q)), w))
                        q += w - before
                    t += 1.0
                if finish:
                    best = math.inf if s["best"] is None else s["best"]
                    worse = tol is not None and s["best"] is not None and s["loss_sum"] > best - tol * len(y)
                    s["stale"] = s["stale"] + 1 if worse else 0
                    s["best"] = min(best, s["loss_sum"])
                    s["loss_sum"] = 0.0
                    if s["stale"] >= patience:
                        s["done"] = True
                        break
            s.update(coef=w.tolist(), q=q.tolist(), intercept=b, t=t, u=u)
        row = pa.table({name: [s[name]] for name in names})
        return row.cast(target)

    target = pa.schema([
        ("client_id", pa.int32()), ("n_examples", pa.int64()), ("status", pa.string()), ("coef", pa.list_(pa.float64())),
        ("intercept", pa.float64()), ("c0", pa.float64()), ("c1", pa.float64()), ("t", pa.float64()), ("u", pa.float64()),
        ("q", pa.list_(pa.float64())), ("loss_sum", pa.float64()), ("best", pa.float64()), ("stale", pa.int32()), ("done", pa.bool_()),
    ])
    if starts is None:
        return rows.groupBy("client_id").cogroup(state.df.groupBy("client_id")).applyInArrow(run_beside, _STATE)
    return rows.groupBy("client_id").applyInArrow(run, _STATE)
