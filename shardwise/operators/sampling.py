"""Client partitions, splits, class balancing and client sampling (all seeded)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.functions.hashing import hash_order
from shardwise.operators.ranking import at_or_before, cutoffs, distributed_rank, numbered, position_key, segment
from shardwise.sources.scratch import Settled, settle

PARTITION = "partition"


def hash_ordered(df: DataFrame, key: list[str], seed: int, purpose: str = "shuffle", name: str = "shuffle_key") -> DataFrame:
    """Add the column that puts rows in a repeatable random order."""
    return df.withColumn(name, hash_order(seed, purpose, *key))


def partition_bounds(df: DataFrame, key: list[str], clients: int, seed: int) -> Settled | None:
    """Where each client but the last ends in hash order, for `iid_partition` of any table with these keys."""

    def ends(sizes: DataFrame) -> DataFrame:
        i = F.explode(F.sequence(F.lit(1), F.lit(clients - 1))) if clients > 1 else F.explode(F.array().cast("array<int>"))
        each, extra = F.floor(F.col("n") / clients), F.col("n") % clients
        return sizes.withColumn("i", i).withColumn("r", F.col("i") * each + F.least(F.col("i"), extra)).dropDuplicates(["r"])

    return cutoffs(df, [], key, seed, PARTITION, ends, per_group=clients) if clients > 1 else None


def iid_partition(df: DataFrame, key: list[str], clients: int, seed: int, bounds: Settled | None = None) -> DataFrame:
    """Deal rows to clients in hash order; sizes differ by at most one, larger ones first."""
    if clients == 1:
        return df.withColumn("client_id", F.lit(0))
    cut = bounds if bounds is not None else partition_bounds(df, key, clients, seed)
    return segment(df, key, seed, PARTITION, cut, "client_id")


def random_split(df: DataFrame, key: list[str], test_fraction: float, seed: int) -> DataFrame:
    """Add `split`: exactly ceil(fraction * n) test rows of the whole table."""
    cut = cutoffs(df, [], key, seed, "split", lambda s: s.withColumn("r", F.ceil(F.lit(test_fraction) * F.col("n"))))
    return _labelled(at_or_before(df, [], key, seed, "split", cut, "picked"), "test", "train")


def split_quotas(counts: DataFrame, by: list[str], label: str, test_fraction: float) -> DataFrame:
    """Test rows per (group, label) from the counts `n`, and whether the group can be stratified.

    The group's test size is rounded up and shared by largest remainder, ties to the lower label.
    A class of one row, or fewer test or train rows than classes, cannot be stratified.
    """
    group = Window.partitionBy(*by)
    total, classes = F.sum("n").over(group), F.count("*").over(group)
    sized = counts.withColumn("test_rows", F.ceil(F.lit(test_fraction) * total)).withColumn("total", total)
    share = F.col("n") * F.col("test_rows") / F.col("total")
    shared = sized.withColumn("whole", F.floor(share)).withColumn("remainder", F.round(share - F.floor(share), 9))
    left = F.col("test_rows") - F.sum("whole").over(group)
    place = F.row_number().over(group.orderBy(F.col("remainder").desc(), F.col(label)))
    feasible = (
        (F.min("n").over(group) >= 2)
        & (F.col("test_rows") >= classes)
        & (F.col("total") - F.col("test_rows") >= classes)
    )
    return shared.select(
        *by, label, "n",
        (F.col("whole") + F.when(place <= left, 1).otherwise(0)).alias("r"),
        feasible.alias("feasible"),
    )


def stratified_split(
    df: DataFrame, by: list[str], label: str, key: list[str], test_fraction: float, seed: int, purpose: str = "stratify",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add `split` per group with class shares kept; rows of a group that cannot be split get null.

    `counted` holds the same rows without the wide columns, if there is such a table to count over.
    """
    cut = cutoffs(
        df if counted is None else counted, [*by, label], key, seed, purpose,
        lambda sizes: split_quotas(sizes, by, label, test_fraction).withColumn(
            "r", F.when(F.col("feasible"), F.greatest(F.col("r"), F.lit(0))).otherwise(F.lit(0))
        ),
    )
    # A group that can be split has a test row in some class, hence a cutoff.
    able = settle(cut.df.select(*by).distinct().withColumn("feasible", F.lit(True)))
    flagged = at_or_before(df, [*by, label], key, seed, purpose, cut, "picked")
    named = _labelled(flagged.join(able.side(), by, "left"), "test", "train")
    return named.withColumn("split", F.when(F.col("feasible"), F.col("split"))).drop("feasible")


def ordered_split(
    df: DataFrame, by: list[str], key: list[str], train_fraction: float, seed: int, purpose: str = PARTITION, counted: DataFrame | None = None
) -> DataFrame:
    """Add `split`: the first floor(fraction * n) rows of each group, in the group's own order, train."""
    cut = cutoffs(df if counted is None else counted, by, key, seed, purpose, lambda s: s.withColumn("r", F.floor(F.lit(train_fraction) * F.col("n"))))
    return _labelled(at_or_before(df, by, key, seed, purpose, cut, "picked"), "train", "test")


def central_head_test(df: DataFrame, key: list[str], client: int, fraction: float, seed: int) -> DataFrame:
    """The first floor(fraction * n) rows of one client."""
    one = df.where(F.col("client_id") == client)
    return ordered_split(one, ["client_id"], key, fraction, seed).where(F.col("split") == "train").drop("split")


def central_union_test(df: DataFrame, clients: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """The test rows of the named clients together."""
    return df.where(F.col("client_id").isin(*clients) & (F.col("split") == "test"))


def undersample(df: DataFrame, by: list[str], label: str, key: list[str], ratio: float, seed: int) -> DataFrame:
    """Keep every positive row and int(positives * ratio) negatives; all of them where there are fewer."""

    def targets(sizes: DataFrame) -> DataFrame:
        return _kept_rows(sizes, by, label, ratio).withColumnRenamed("kept", "r").where(F.col(label) == 0)

    cut = cutoffs(df, [*by, label], key, seed, "undersample", targets)
    flagged = at_or_before(df, [*by, label], key, seed, "undersample", cut, "picked")
    return flagged.where((F.col(label) == 1) | F.col("picked")).drop("picked")


def _kept_rows(sizes: DataFrame, by: list[str], label: str, ratio: float) -> DataFrame:
    """Rows undersampling keeps of each class."""
    positives = F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).over(Window.partitionBy(*by))
    target = F.least(F.col("n"), F.floor(positives * F.lit(float(ratio))))
    return sizes.withColumn("kept", F.when(F.col(label) == 0, target).otherwise(F.col("n")))


def oversample(df: DataFrame, by: list[str], label: str, key: list[str], ratio: float, seed: int, counted: DataFrame | None = None) -> DataFrame:
    """Replace the positives of each group by int(positives * ratio) draws with replacement.

    The positive at rank r starts draws r, r + positives, ... so draws are as spread as the rows.
    Each draw hashes to the rank it picks; picks are counted before the wide rows are touched.
    `copy` numbers the copies of a row (0 for negatives).
    """
    positives = (df if counted is None else counted).where(F.col(label) == 1).select(*by, *key)
    sizes = settle(positives.groupBy(*by).agg(F.count("*").alias("positives")))
    ranked = distributed_rank(positives, by, key, seed, "oversample", "rank").join(sizes.side(), by)
    draws = F.floor(F.col("positives") * F.lit(float(ratio)))
    picks = (
        ranked.where(F.col("rank") <= draws)
        .select(*by, "positives", F.explode(F.sequence(F.col("rank") - 1, draws - 1, F.col("positives"))).alias("draw"))
        .withColumn("rank", 1 + _hash_int(seed, "draw", *by, "draw") % F.col("positives"))
        .groupBy(*by, "rank")
        .agg(F.count("*").alias("copies"))
    )
    counted = ranked.join(picks, [*by, "rank"]).select(*by, *key, "copies")
    drawn = (
        df.where(F.col(label) == 1)
        .join(counted, [*by, *key])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("copies")
    )
    kept = df.where(F.col(label) == 0).withColumn("copy", F.lit(0))
    return kept.unionByName(drawn)


def balance(df: DataFrame, method: str | None, by: list[str], label: str, key: list[str], ratio: float, seed: int) -> DataFrame:
    """Undersample, oversample or leave the classes as they are."""
    if method in (None, "none"):
        return df
    if method == "undersample":
        return undersample(df, by, label, key, ratio, seed)
    if method == "oversample":
        return oversample(df, by, label, key, ratio, seed)
    raise ValueError(f"unknown balance method: {method}")


def balanced_split(
    df: DataFrame, method: str | None, by: list[str], label: str, key: list[str], ratio: float, test_fraction: float, seed: int,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Balance the classes, then split them: the job's two steps in as few passes as they allow.

    Undersampling keeps the first rows of each class in hash order, so the split can take its test
    rows from the front of the same order. Both bounds are then found together, and the result is
    that of `undersample` followed by `stratified_split` with the same purpose. All counting is done
    over `counted` if given: the same rows with no column but `by`, the label and the key.
    """
    counted = df if counted is None else counted
    if method == "oversample":
        drawn = [oversample(rows, by, label, key, ratio, seed, counted) for rows in (df, counted)]
        return stratified_split(drawn[0], by, label, [*key, "copy"], test_fraction, seed, counted=drawn[1])
    if method != "undersample":
        return stratified_split(balance(df, method, by, label, key, ratio, seed), by, label, key, test_fraction, seed, counted=counted)

    groups = [*by, label]

    def bounds(sizes: DataFrame) -> DataFrame:
        kept = _kept_rows(sizes, by, label, ratio).select(*groups, F.col("kept").alias("n")).where(F.col("n") > 0)
        quotas = split_quotas(kept, by, label, test_fraction)
        tests = F.when(F.col("feasible"), F.col("r")).otherwise(F.lit(0))
        return quotas.select(*groups, F.explode(F.array(F.col("n"), tests)).alias("r"))

    cut = cutoffs(counted, groups, key, seed, "undersample", bounds, per_group=2)
    # The later bound ends the kept rows, an earlier one ends the test rows.
    both = cut.df.groupBy(*groups).agg(F.max("cut").alias("last_kept"), F.expr("CASE WHEN count(*) > 1 THEN min(cut) END AS last_test"))
    able = F.count("last_test").over(Window.partitionBy(*by)) > 0
    lookup = both.withColumn("able", able)
    mine = position_key(seed, "undersample", key)
    joined = df.join(F.broadcast(lookup) if cut.small else lookup, groups).withColumn("pos", mine)
    split = F.when(F.col("pos") <= F.col("last_test"), "test").otherwise("train")
    return (
        joined.where(F.col("pos") <= F.col("last_kept"))
        .withColumn("split", F.when(F.col("able"), split))
        .drop("pos", "last_kept", "last_test", "able")
    )


def sample_clients(
    clients: DataFrame, fraction: float, minimum: int, rounds: Sequence[int], seed: int, min_available: int = 2, purpose: str = "fit"
) -> DataFrame:
    """Clients taking part in each round: max(int(fraction * N), minimum), none if too few exist."""
    available = clients.count()
    size = max(int(fraction * available), minimum) if available >= min_available else 0
    drawn = clients.select("client_id").withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds])))
    drawn = drawn.withColumn("digest", hash_order(seed, purpose, "round", "client_id"))
    placed = numbered(drawn, ["round"], [("digest", "ascending"), ("client_id", "ascending")], "place")
    return placed.df.where(F.col("place") < size).select("round", "client_id")


def _hash_int(seed: int, purpose: str, *key: str) -> Column:
    return F.conv(F.substring(hash_order(seed, purpose, *key), 1, 8), 16, 10).cast("bigint")


def _labelled(df: DataFrame, yes: str, no: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col("picked"), yes).otherwise(no)).drop("picked")
