"""Local training of linear models, every client in the same jobs.

Clients small enough for one task are trained whole, all epochs of a round in one job. Larger
clients are trained one epoch per job: tasks add up the gradient of their own rows per client, so
only sums are shuffled and one client may hold any share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwise.functions.hashing import hash_order, normal
from shardwise.functions.linear import UNROLL, decision, penalty_parts, residual, stepped_weight
from shardwise.sources.scratch import Settled, local_table, scratch_dir, settle
from shardwise.sources.state import PARAMS_SCHEMA

# Values (rows x features) of the largest client that one task may hold.
TASK_VALUES = 10_000_000
# Weights of all clients together that are sent to every task.
MODEL_VALUES = 4_000_000

# Clients whose parameters the driver holds between rounds, and their weights together; beyond, parameters are a table of
# blocks of BLOCK_WEIGHTS.
CLIENT_ROWS = 50_000
DRIVER_WEIGHTS = 16_000_000
BLOCK_WEIGHTS = 4_096


@dataclass(frozen=True)
class Learner:
    """What is minimised and for how long."""

    loss: str
    penalty: str | None
    epochs: int
    alpha: float | None = None
    c: float | None = None
    balanced: bool = False
    tol: float | None = 1e-4
    l1_ratio: float = 0.15
    fit_intercept: bool = True

    @property
    def curvature(self) -> float:
        """Bound of the second derivative of the row loss (the hinge has none: unit step)."""
        return {"log_loss": 0.25, "modified_huber": 2.0}.get(self.loss, 1.0)


def learner(loss: str, penalty: str | None, local_epochs: int, **changes) -> Learner:
    """The learner a loss name stands for; any other name than the two SGD losses means logistic."""
    # Strengths, epoch factor and tolerance of the three learners.
    if loss == "hinge":
        made = Learner("hinge", penalty, local_epochs, alpha=0.001, tol=1e-4)
    elif loss == "modified_huber":
        made = Learner("modified_huber", penalty, local_epochs, alpha=0.0001, balanced=True, tol=1e-4)
    else:
        made = Learner("log_loss", penalty, local_epochs * 5, c=1.0, tol=1e-4)
    return replace(made, **changes)


def initial_params(spark: SparkSession, width: int, seed: int, fit_intercept: bool = True, scale: float = 0.01) -> DataFrame:
    """The starting global model: weights and intercept drawn from N(0, scale)."""
    draws = spark.range(width + 1).select("id", normal(hash_order(seed, "init", "id"), scale).alias("w"))
    ordered = F.sort_array(F.collect_list(F.struct("id", "w")))
    all_weights = F.transform(ordered, lambda e: e["w"])
    one = draws.agg(all_weights.alias("w"))
    bias = F.element_at("w", width + 1) if fit_intercept else F.lit(None).cast("double")
    return one.select(
        F.lit(0).alias("round"),
        F.lit(None).cast("int").alias("client_id"),
        F.lit(0).cast("bigint").alias("n_examples"),
        F.lit("ok").alias("status"),
        F.slice("w", 1, width).alias("coef"),
        bias.alias("intercept"),
    )


def client_stats(train: DataFrame, made: Learner) -> DataFrame:
    """Per client: rows, class weights, step 1/L and strength. The data side of every epoch.

    L is bounded by the trace of the (class-weighted) second moments including the intercept.
    """
    square = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v) + F.lit(1.0 if made.fit_intercept else 0.0)
    sums = train.groupBy("client_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 0).alias("n0"),
        F.count_if(F.col("label") == 1).alias("n1"),
        F.sum(F.when(F.col("label") == 0, square).otherwise(0.0)).alias("s0"),
        F.sum(F.when(F.col("label") == 1, square).otherwise(0.0)).alias("s1"),
    )
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    c0, c1 = F.lit(1.0), F.lit(1.0)
    if made.balanced:
        c0 = F.when(both, F.col("n") / (2.0 * F.col("n0"))).otherwise(1.0)
        c1 = F.when(both, F.col("n") / (2.0 * F.col("n1"))).otherwise(1.0)
    strength = F.lit(made.alpha) if made.alpha is not None else 1.0 / (F.lit(made.c) * F.col("n"))
    # Features that are all zero have no step: such a client is reported as failed.
    bound = made.curvature * (F.col("c0") * F.col("s0") + F.col("c1") * F.col("s1"))
    return sums.withColumns({"c0": c0, "c1": c1}).select(
        "client_id", "n", "n0", "n1", "c0", "c1",
        F.when(bound > 0, F.col("n") / bound).otherwise(0.0).alias("step"),
        strength.alias("strength"),
        F.when(both & (bound > 0), "ok").otherwise("failed").alias("status"),
    )


def start_from(stats: DataFrame, params: DataFrame) -> DataFrame:
    """One starting row per client: its own parameters if the table has them, else the global model."""
    own = params.where(F.col("client_id").isNotNull()).select("client_id", "coef", "intercept")
    shared = params.where(F.col("client_id").isNull()).orderBy(F.desc("round")).limit(1).collect()  # the latest global model
    joined = stats.join(own, "client_id", "left")
    if not shared:
        return joined.where(F.col("coef").isNotNull()).withColumn("done", F.lit(False))
    mine = F.col("coef").isNotNull()
    g_coef = F.array(*[F.lit(w) for w in shared[0]["coef"]])
    return joined.select(
        *stats.columns,
        F.when(mine, F.col("coef")).otherwise(g_coef).alias("coef"),
        F.when(mine, F.col("intercept")).otherwise(F.lit(shared[0]["intercept"]).cast("double")).alias("intercept"),
        F.lit(False).alias("done"),
    )


def starting_state(stats: Settled, params: DataFrame | Settled) -> Settled:
    """`start_from` evaluated. With both tables on the driver the rows are simply put together."""
    held = isinstance(params, Settled) and params.rows is not None and stats.rows is not None
    if not held or stats.rows.num_rows * (_width(params) + 1) > MODEL_VALUES:
        model = params.df if isinstance(params, Settled) else params
        return settle(start_from(stats.df, model), limit=CLIENT_ROWS)
    own = {p["client_id"]: p for p in sorted(params.records(), key=lambda p: p["round"] or 0)}  # the latest of each
    rows = [
        {**r, "coef": own.get(r["client_id"], own.get(None))["coef"], "intercept": own.get(r["client_id"], own.get(None))["intercept"], "done": False}
        for r in stats.records()
        if r["client_id"] in own or None in own
    ]
    schema = stats.rows.schema
    for name, kind in (("coef", pa.list_(pa.float64())), ("intercept", pa.float64()), ("done", pa.bool_())):
        schema = schema.append(pa.field(name, kind))
    return local_table(stats.df.sparkSession, pa.Table.from_pylist(rows, schema=schema))


def local_fit(
    train: DataFrame,
    params: DataFrame | Settled,
    made: Learner,
    epochs: int | None = None,
    stats: Settled | None = None,
    form: str = "auto",
    step: float | None = None,
    round_no: int | None = None,
) -> DataFrame:
    """Fit every client of `train` (client_id, label, x) from the given weights; the result is a params table.

    `form` is "whole" (one job per call), "epochs" (one job per epoch), "blocks" (likewise, the weights of all clients in a
    table of blocks that never reaches the driver) or "auto" by size. All give the same weights. `step` overrides the step 1/L.
    """
    epochs = made.epochs if epochs is None else epochs
    stats = stats or settle(client_stats(train, made), limit=CLIENT_ROWS)
    if form == "blocks" or (form == "auto" and _weights(stats, params) > DRIVER_WEIGHTS):
        return _fit_by_block(train, stats.df, params.df if isinstance(params, Settled) else params, made, epochs, step, round_no)
    begin = starting_state(stats, params)
    width = _width(begin)
    if form == "auto":
        form = "whole" if fits_tasks(begin, width) else "epochs"
    if form == "whole":
        return _fit_whole(train, begin, made, epochs, step, round_no)
    return _fit_by_epoch(train, begin, made, epochs, width, step, round_no)


def _weights(stats: Settled, params: DataFrame | Settled) -> int:
    """Weights of all clients together."""
    if isinstance(params, Settled) and params.rows is not None:
        width = _width(params)
    else:
        first = (params.df if isinstance(params, Settled) else params).select(F.size("coef").alias("width")).first()
        width = first["width"] if first else 0
    return (stats.rows.num_rows if stats.rows is not None else stats.df.count()) * (width + 1)


def client_limit(width: int) -> int:
    """Clients whose parameters may come to the driver."""
    return max(1, min(CLIENT_ROWS, DRIVER_WEIGHTS // (width + 1)))


def fits_tasks(stats: Settled, width: int) -> bool:
    """Whether the largest client fits one task and all weights fit every task."""
    if stats.rows is None:
        return False
    return stats.largest("n") * (width + 1) <= TASK_VALUES and stats.rows.num_rows * (width + 1) <= MODEL_VALUES


def _width(begin: Settled) -> int:
    if begin.rows is not None:
        return len(begin.rows.column("coef")[0]) if begin.rows.num_rows else 0
    return begin.df.select(F.max(F.size("coef"))).first()[0]


def _fit_whole(train: DataFrame, begin: Settled, made: Learner, epochs: int, fixed_step: float | None, round_no: int | None) -> DataFrame:
    """All epochs of a client inside the task that holds it."""
    starts = {r["client_id"]: r for r in begin.records()}
    loss, fit_intercept, tol = made.loss, made.fit_intercept, made.tol
    l1, l2 = penalty_parts(made.penalty, made.l1_ratio)
    slope = _slope(loss)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        start = starts[key[0].as_py()]
        w, b = np.array(start["coef"], dtype=float), float(start["intercept"] or 0.0)
        y = table.column("label").to_numpy().astype(float)
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(w))
        weight = np.where(y == 1, start["c1"], start["c0"]) / len(y)
        step, strength = fixed_step or start["step"], start["strength"]
        done = start["status"] != "ok"
        for _ in range(epochs):
            if done:
                break
            r = slope(y, x @ w + b) * weight
            new = w - step * (r @ x)
            new = np.sign(new) * np.maximum(np.abs(new) - step * strength * l1, 0.0) / (1.0 + step * strength * l2)
            new_b = b - step * r.sum() if fit_intercept else b
            moved = max(np.max(np.abs(new - w), initial=0.0), abs(new_b - b))
            size = max(np.max(np.abs(new), initial=0.0), abs(new_b))
            w, b = new, new_b
            done = tol is not None and moved <= tol * size
        good = start["status"] == "ok" and np.isfinite(w).all() and np.isfinite(b)
        return pa.table({
            "round": pa.array([round_no], pa.int32()),
            "client_id": pa.array([key[0].as_py()], pa.int32()),
            "n_examples": pa.array([len(y)], pa.int64()),
            "status": ["ok" if good else "failed"],
            "coef": pa.array([w.tolist()], pa.list_(pa.float64())),
            "intercept": pa.array([b if fit_intercept else None], pa.float64()),
        })

    return train.select("client_id", "label", "x").groupBy("client_id").applyInArrow(fit, PARAMS_SCHEMA)


def _slope(loss: str):
    """Numpy form of `residual`, nested so that tasks get it by value."""

    def logistic(y, f):
        return 1.0 / (1.0 + np.exp(-np.clip(f, -709.0, 709.0))) - y

    def hinge(y, f):
        z = 2.0 * y - 1.0
        return np.where(z * f < 1, -z, 0.0)

    def huber(y, f):
        z = 2.0 * y - 1.0
        return np.where(z * f >= 1, 0.0, np.where(z * f > -1, -2.0 * z * (1.0 - z * f), -4.0 * z))

    return {"hinge": hinge, "modified_huber": huber}.get(loss, logistic)


def _fit_by_epoch(
    train: DataFrame, begin: Settled, made: Learner, epochs: int, width: int, fixed_step: float | None, round_no: int | None
) -> DataFrame:
    """One gradient job per epoch; only per-client sums and weights leave the tasks."""
    state = begin if fixed_step is None else settle(begin.df.withColumn("step", F.lit(float(fixed_step))), limit=CLIENT_ROWS)
    for _ in range(epochs):
        active = _active(state)
        if active is None:
            break
        sums = gradient_sums(train, active, made.loss, width)
        state = settle(weight_step(state.df, sums, made), limit=CLIENT_ROWS)
    finite = F.forall("coef", lambda w: ~F.isnan(w) & (F.abs(w) < float("inf"))) & ~F.isnan(F.coalesce("intercept", F.lit(0.0)))
    good = (F.col("status") == "ok") & finite
    bias = F.col("intercept") if made.fit_intercept else F.lit(None).cast("double")
    return state.df.select(
        F.lit(round_no).cast("int").alias("round"), "client_id", F.col("n").alias("n_examples"),
        F.when(good, "ok").otherwise("failed").alias("status"), "coef", bias.alias("intercept"),
    )


def _blocks_of(params: DataFrame, size: int) -> DataFrame:
    """Parameter rows to (client_id, block, w); block -1 is the intercept."""
    count = F.ceil(F.size("coef") / size).cast("int")
    weights = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.struct(b.alias("block"), F.slice("coef", b * size + 1, F.lit(size)).alias("w")))
    bias = F.array(F.struct(F.lit(-1).alias("block"), F.array(F.coalesce("intercept", F.lit(0.0))).alias("w")))
    return params.select("client_id", F.explode(F.concat(weights, bias)).alias("p")).select("client_id", "p.block", "p.w")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fit_by_block(train: DataFrame, stats: DataFrame, params: DataFrame, made: Learner, epochs: int, fixed_step: float | None, round_no: int | None) -> DataFrame:
    """One job per epoch with parameters keyed by (client, block of features).

    A client's rows are dealt to parts that fit a task, once. In each epoch a part meets its client's blocks, a whole model of
    one client, and gives a gradient per block; gradients are added and weights moved block by block, all as tables.
    """
    if fixed_step is not None:
        stats = stats.withColumn("step", F.lit(float(fixed_step)))
    width = F.size("x") + 1
    parts = F.ceil(F.col("n") * width / F.lit(float(TASK_VALUES))).cast("int")
    dealt = train.select("client_id", "label", F.col("x").cast("array<double>").alias("x")).join(stats.select("client_id", "n"), "client_id")
    rows = _stored(dealt.select("client_id", F.floor(F.rand(0) * parts).cast("int").alias("part"), parts.alias("parts"), "label", "x"), "block-rows")
    sizes = _stored(rows.groupBy("client_id").agg(F.max("parts").alias("parts")), "block-parts")
    shared = params.where("client_id is null").orderBy(F.desc("round")).limit(1).drop("client_id")
    own = params.where("client_id is not null").select("client_id", F.struct("coef", "intercept").alias("own"))
    known = stats.join(own, "client_id", "left").withColumn("all", F.lit(1))
    begin = known.join(F.broadcast(shared.select(F.lit(1).alias("all"), F.struct("coef", "intercept").alias("shared"))), "all", "left")  # one row
    begin = begin.select("client_id", F.coalesce("own", "shared").alias("p")).select("client_id", "p.*").where("coef is not null")
    weights = _stored(_blocks_of(begin, BLOCK_WEIGHTS), "block-weights")
    going = _stored(stats.where("status = 'ok'").select("client_id", F.lit(False).alias("done")), "block-going")
    slope, fit_intercept = _slope(made.loss), made.fit_intercept

    def gradient(key: tuple, part: pa.Table, blocks: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
        names = ["client_id", "part", "block", "g"]
        if not part.num_rows or not blocks.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        held = {b: np.array(w) for b, w in zip(blocks.column("block").to_pylist(), blocks.column("w").to_pylist(), strict=True)}
        b, order = float(held.pop(-1)[0]), sorted(held)
        w = np.concatenate([held[k] for k in order])
        y = part.column("label").to_numpy().astype(float)
        x = part.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        c0, c1 = (blocks.column(c)[0].as_py() for c in ("c0", "c1"))
        r = slope(y, x @ w + b) * np.where(y == 1, c1, c0)
        g = np.split(r @ x, np.cumsum([len(held[k]) for k in order])[:-1])
        out = [(k, v.tolist()) for k, v in zip(order, g, strict=True)] + [(-1, [float(r.sum()) if fit_intercept else 0.0])]
        client, number = key[0].as_py(), key[1].as_py()
        return pa.table([pa.array([client] * len(out), kinds[0]), pa.array([number] * len(out), kinds[1]), pa.array([k for k, _ in out], kinds[2]), pa.array([v for _, v in out], kinds[3])], names)

    n, step, strength = F.col("n").cast("double"), F.col("step"), F.col("strength")
    bias = F.col("block") == -1
    moved_weight = lambda w, g: F.when(bias, w - step * g / n).otherwise(stepped_weight(w, g / n, step, strength, made.penalty, made.l1_ratio))
    for _ in range(epochs):
        active = going.where("not done").select("client_id")
        if active.isEmpty():
            break
        models = weights.join(active, "client_id").join(stats.select("client_id", "c0", "c1"), "client_id").join(sizes, "client_id")
        models = models.select("client_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "w", "c0", "c1")
        pieces = rows.groupBy("client_id", "part").cogroup(models.groupBy("client_id", "part")).applyInArrow(gradient, "client_id int, part int, block int, g array<double>")
        # As many pieces as a client has parts, in their order.
        listed = pieces.groupBy("client_id", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "g"))), lambda p: p["g"]).alias("gs"))
        added = F.aggregate(F.slice("gs", F.lit(2), F.size("gs")), F.get("gs", F.lit(0)), lambda a, g: F.zip_with(a, g, lambda u, v: u + v))
        moved = weights.join(listed.select("client_id", "block", added.alias("g")), ["client_id", "block"]).join(stats, "client_id")
        moved = moved.withColumn("new", F.zip_with("w", "g", moved_weight))
        change, largest = F.array_max(F.zip_with("w", "new", lambda a, b: F.abs(b - a))), F.array_max(F.transform("new", F.abs))
        taken = _stored(moved.select("client_id", "block", "new", change.alias("moved"), largest.alias("size")), "block-moved")
        stop = F.max("moved") <= F.lit(made.tol) * F.max("size") if made.tol is not None else F.lit(False) & (F.max("moved") > 0)
        ended = taken.groupBy("client_id").agg(stop.alias("stop"))
        weights = _stored(weights.join(taken.select("client_id", "block", "new"), ["client_id", "block"], "left").select("client_id", "block", F.coalesce("new", "w").alias("w")), "block-weights")
        going = _stored(going.join(ended, "client_id", "left").select("client_id", (F.col("done") | F.coalesce("stop", F.lit(False))).alias("done")), "block-going")
    whole = weights.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("block", "w"))).alias("b"))
    whole = whole.select("client_id", F.flatten(F.transform(F.slice("b", F.lit(2), F.size("b")), lambda e: e["w"])).alias("coef"), F.get(F.col("b")[0]["w"], F.lit(0)).alias("intercept"))
    finite = F.forall("coef", lambda w: ~F.isnan(w) & (F.abs(w) < float("inf"))) & ~F.isnan("intercept")
    return whole.join(stats, "client_id").select(
        F.lit(round_no).cast("int").alias("round"), "client_id", F.col("n").alias("n_examples"),
        F.when((F.col("status") == "ok") & finite, "ok").otherwise("failed").alias("status"), "coef",
        (F.col("intercept") if made.fit_intercept else F.lit(None).cast("double")).alias("intercept"),
    )


def _active(state: Settled) -> Settled | None:
    """Clients that still train; None when all are done."""
    going = state.df.where((F.col("status") == "ok") & ~F.col("done"))
    if state.rows is not None:
        rows = state.rows.filter(pc.and_(pc.equal(state.rows["status"], "ok"), pc.invert(state.rows["done"])))
        return Settled(going, rows) if rows.num_rows else None
    return Settled(going, None) if going.limit(1).count() else None


def gradient_sums(train: DataFrame, active: Settled, loss: str, width: int) -> DataFrame:
    """Class-weighted gradient sums per client: (client_id, g array, gb)."""
    if width <= UNROLL:
        return _native_sums(train, active, loss, width)
    if active.rows is not None and active.rows.num_rows * (width + 1) <= MODEL_VALUES:
        return _arrow_sums(train, active, loss)
    return _exploded_sums(train, active, loss)


def _rows_with_slope(train: DataFrame, active: Settled, loss: str, width: int | None) -> DataFrame:
    rows = train.select("client_id", "label", "x").join(active.side().select("client_id", "coef", "intercept", "c0", "c1"), "client_id")
    y = F.col("label").cast("double")
    f = decision(F.col("x"), F.col("coef"), F.col("intercept"), width)
    weight = F.when(F.col("label") == 1, F.col("c1")).otherwise(F.col("c0"))
    return rows.select("client_id", "x", (weight * residual(y, f, loss)).alias("r"))


def _native_sums(train: DataFrame, active: Settled, loss: str, width: int) -> DataFrame:
    sums = [F.sum(F.col("r") * F.get("x", F.lit(i))).alias(f"g{i}") for i in range(width)]
    grouped = _rows_with_slope(train, active, loss, width).groupBy("client_id").agg(F.sum("r").alias("gb"), *sums)
    return grouped.select("client_id", F.array(*[F.col(f"g{i}") for i in range(width)]).alias("g"), "gb")


def _exploded_sums(train: DataFrame, active: Settled, loss: str) -> DataFrame:
    """The all-native form for any width and any number of clients."""
    rows = _rows_with_slope(train, active, loss, None)
    entries = F.concat(F.transform("x", lambda v: v * F.col("r")), F.array(F.col("r")))
    return _regroup(rows.select("client_id", F.posexplode(entries).alias("i", "v")))


def _arrow_sums(train: DataFrame, active: Settled, loss: str) -> DataFrame:
    """Wide rows: one partial sum per (task, client), batch by batch."""
    models = {
        r["client_id"]: (np.array(r["coef"]), float(r["intercept"] or 0.0), r["c0"], r["c1"])
        for r in active.records()
    }
    slope = _slope(loss)

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            ids = batch.column("client_id").to_numpy()
            y = batch.column("label").to_numpy().astype(float)
            x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
            for client in np.unique(ids):
                if client not in models:
                    continue
                w, b, c0, c1 = models[client]
                here = ids == client
                r = slope(y[here], x[here] @ w + b) * np.where(y[here] == 1, c1, c0)
                g = np.append(r @ x[here], r.sum())
                sums[client] = sums[client] + g if client in sums else g
        yield pa.RecordBatch.from_pydict({
            "client_id": pa.array(list(sums), pa.int32()),
            "g": pa.array([g.tolist() for g in sums.values()], pa.list_(pa.float64())),
        })

    parts = train.select("client_id", "label", "x").mapInArrow(partial, "client_id INT, g ARRAY<DOUBLE>")
    return _regroup(parts.select("client_id", F.posexplode("g").alias("i", "v")))


def _regroup(entries: DataFrame) -> DataFrame:
    """Sum (client, position) entries and put them back in order; the last position is the intercept."""
    sums = entries.groupBy("client_id", "i").agg(F.sum("v").alias("v"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"])
    return (
        sums.groupBy("client_id")
        .agg(ordered.alias("all"))
        .select("client_id", F.slice("all", F.lit(1), F.size("all") - 1).alias("g"), F.element_at("all", -1).alias("gb"))
    )


def weight_step(state: DataFrame, sums: DataFrame, made: Learner) -> DataFrame:
    """Apply one step to every client that has gradient sums; the others stay as they are."""
    joined = state.join(sums, "client_id", "left")
    n, step, strength = F.col("n").cast("double"), F.col("step"), F.col("strength")
    new = F.zip_with("coef", "g", lambda w, g: stepped_weight(w, g / n, step, strength, made.penalty, made.l1_ratio))
    old_b = F.coalesce(F.col("intercept"), F.lit(0.0))
    new_b = old_b - step * F.col("gb") / n if made.fit_intercept else old_b
    moved = F.greatest(F.array_max(F.zip_with("coef", "new", lambda a, b: F.abs(b - a))), F.abs(F.col("new_b") - old_b))
    size = F.greatest(F.array_max(F.transform("new", F.abs)), F.abs("new_b"))
    stop = moved <= F.lit(made.tol) * size if made.tol is not None else F.lit(False)
    stepped = joined.withColumns({"new": new, "new_b": new_b}).withColumn("stop", stop)
    taken = F.col("g").isNotNull()
    return stepped.select(
        *[c for c in state.columns if c not in ("coef", "intercept", "done")],
        F.when(taken, F.col("new")).otherwise(F.col("coef")).alias("coef"),
        F.when(taken, F.col("new_b")).otherwise(F.col("intercept")).alias("intercept"),
        F.when(taken, F.col("stop")).otherwise(F.col("done")).alias("done"),
    )
