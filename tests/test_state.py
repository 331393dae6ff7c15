"""Stored state and the preparation of files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shardwise.operators.scaling import apply_scaler, fit_scaler
from shardwise.plans.preparation import prepare
from shardwise.sources.observations import assemble, feature_columns, prepared, prepared_key, read_observations
from shardwise.sources.scratch import settle
from shardwise.sources.state import (
    latest_params, load_scaler, params_row, read_params, save_scaler, with_params, write_params,
)


def test_feature_columns(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 1)], ["Unnamed: 0", "a", "b", "label"])
    assert feature_columns(df) == ["a", "b"]


def test_constant_feature_gets_scale_one(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], ["a", "b"])
    save_scaler(fit_scaler(df, ["a", "b"]), str(tmp_path / "s"))
    scaler = load_scaler(spark, str(tmp_path / "s"))
    assert {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()} == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert [tuple(r) for r in apply_scaler(df, scaler, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        apply_scaler(df.withColumn("c", F.lit(1.0)), scaler, ["c"])


def test_wide_scaler_equals_the_narrow_one(spark):
    names = [f"f{i}" for i in range(40)]
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(n) for i, n in enumerate(names)])
    wide = {r["feature"]: (r["mean"], r["scale"]) for r in fit_scaler(df, names).collect()}
    narrow = {r["feature"]: (r["mean"], r["scale"]) for r in fit_scaler(df, names[:8]).collect()}
    for n in names[:8]:
        assert wide[n] == pytest.approx(narrow[n], abs=1e-12)


def test_single_precision(spark):
    value = assemble(spark.createDataFrame([(0.1,)], ["a"]), ["a"], "float").first()["x"][0]
    assert value != 0.1 and value == pytest.approx(0.1, abs=1e-8)


def test_prepared_rows_are_written_once(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("client_id"))
    first = prepared(df, str(tmp_path), source="a", n=2)
    second = prepared(df.limit(0), str(tmp_path), source="a", n=2)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) and second.count() == 10
    assert prepared(df.limit(0), str(tmp_path), source="a", n=3).count() == 0
    assert prepared_key(a=1, b=2) == prepared_key(b=2, a=1) != prepared_key(a=2, b=1)


def test_parameters_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, 1.5, -2.0)], "client_id int, n_examples bigint, a double, b double")
    params = params_row(df, [F.col("a"), F.col("b")])
    for round_no in (1, 2, 2):
        write_params(params.withColumn("n_examples", F.lit(round_no)), str(tmp_path / "p"), round_no)
    assert read_params(spark, str(tmp_path / "p")).count() == 2
    last = latest_params(spark, str(tmp_path / "p"))
    assert tuple(last.first()) == (2, 1, 2, None, [1.5, -2.0], None)
    assert with_params(spark.createDataFrame([(1,)], "client_id int"), last, ["client_id"]).first()["coef"] == [1.5, -2.0]


def test_csv_to_train_and_test(spark, tmp_path):
    source = tmp_path / "raw.csv"
    source.write_text("Unnamed: 0,a,label\n" + "\n".join(f"{i},{i / 2},{i % 2}" for i in range(21)))
    prepare(spark, str(source), str(tmp_path / "out"))
    parts = {s: read_observations(spark, str(tmp_path / "out" / f"split={s}"), "csv") for s in ("train", "test")}
    assert parts["test"].count() == 5 and parts["train"].count() == 16
    assert parts["train"].columns == ["Unnamed: 0", "a", "label"] and dict(parts["train"].dtypes)["a"] == "double"


def test_large_results_do_not_come_to_the_driver(spark):
    big = settle(spark.range(50), limit=10)
    assert not big.small and big.df.count() == 50 and big.largest("id") == 49
    assert big.only("id", [3, 4]).df.count() == 2
    with pytest.raises(ValueError):
        big.records()
