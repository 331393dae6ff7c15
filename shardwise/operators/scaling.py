"""Standard scaling as a small table and column arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Beyond this many columns one aggregate expression per column compiles slower than it runs: tasks then add up whole
# batches as arrays of counts, means and squared deviations, and a row per task and feature is merged.
COLUMN_LIMIT = 32


def fit_scaler(df: DataFrame, features: list[str], scope: str = "all", client: int = 0, x: str | None = None) -> DataFrame:
    """Mean and population deviation per feature: (feature, mean, scale, n).

    The features are columns of `df`, or with `x` the positions of one array column.
    `scope="first"` fits on one client only. A constant feature gets scale 1.
    """
    rows = df.where(F.col("client_id") == client) if scope == "first" else df
    values = [F.get(x, F.lit(i)) if x else F.col(c).cast("double") for i, c in enumerate(features)]
    names = F.array(*[F.lit(c) for c in features])
    if len(features) <= COLUMN_LIMIT:
        stats = [F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("scale"), F.count(v).alias("n")) for v in values]
        one = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)])
        long = one.select(F.posexplode(F.array(*[F.col(f"s{i}") for i in range(len(stats))])).alias("i", "s")).select("i", "s.*")
    else:
        vectors = rows.select((F.col(x) if x else F.array(*values)).cast("array<double>").alias("x"))
        long = merged_moments(vectors.mapInArrow(_moments(), "i int, n long, mean double, m2 double"))
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))
    return long.select(F.element_at(names, F.col("i") + 1).alias("feature"), "mean", scale.alias("scale"), "n")


def _moments():
    def run(batches):
        n = mean = m2 = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            v = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(v.shape)
            own = known.sum(axis=0)
            at = np.where(known, v, 0.0).sum(axis=0) / np.maximum(own, 1)
            spread = (np.where(known, v - at, 0.0) ** 2).sum(axis=0)
            if n is None:
                n, mean, m2 = own, at, spread
                continue
            both, step = n + own, at - mean
            share = own / np.maximum(both, 1)
            n, mean, m2 = both, mean + step * share, m2 + spread + step * step * n * share
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64()), pa.array(mean), pa.array(m2)], ["i", "n", "mean", "m2"])

    return run


def merged_moments(partial: DataFrame) -> DataFrame:
    """Moments (i, n, mean, m2) of parts, a row per task and position, put together: i, mean, scale (deviation), n."""

    def both(a, b):
        n, step = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"] / F.greatest(n, F.lit(1))
        return F.struct(n.alias("n"), (a["mean"] + step * share).alias("mean"), (a["m2"] + b["m2"] + step * step * a["n"] * share).alias("m2"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    parts = partial.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("n", "mean", "m2"))).alias("parts"))
    whole = parts.select("i", F.aggregate("parts", zero, both).alias("s"))
    some = F.col("s.n") > 0
    return whole.select("i", F.when(some, F.col("s.mean")).alias("mean"), F.when(some, F.sqrt(F.col("s.m2") / F.col("s.n"))).alias("scale"), F.col("s.n").alias("n"))


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str], x: str | None = None) -> DataFrame:
    """Replace each feature by (x - mean) / scale; one value pair per feature comes to the driver."""
    rows = scaler.where(F.col("feature").isin(*features)).limit(len(features) + 1).collect()
    table = {r["feature"]: r for r in rows}
    if len(table) < len(rows):
        raise ValueError("scaler has several rows for one feature")
    missing = [c for c in features if c not in table]
    if missing:
        raise ValueError(f"scaler has no row for {missing}")
    means, scales = ([table[c][part] for c in features] for part in ("mean", "scale"))
    if x is None:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(features, means, scales)})
    if len(features) <= COLUMN_LIMIT:
        scaled = F.array(*[(F.get(x, F.lit(i)) - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(means, scales))])
    else:
        mean_at, scale_at = (F.array(*[F.lit(v) for v in part]) for part in (means, scales))
        scaled = F.transform(x, lambda v, i: (v - F.get(mean_at, i)) / F.get(scale_at, i))
    return df.withColumn(x, scaled)
