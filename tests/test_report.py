"""Round logs and the summary."""

from __future__ import annotations

import json

import pytest

from shardwise.operators.report import convergence_flags, series, summary
from shardwise.plans.reporting import report
from shardwise.sources.rounds import ROUND_COLUMNS, read_round_log, write_round_log

# First and last round of a published SVM run.
FIRST = (1, 5012873313988486.0, 0.5560970327052198, 0.42888784509861144, 0.9998375568551007, 0.6002723679980071, 0.6657735663813779, 0.00016244314489928524)
LAST = (10, 407343728.52393585, 0.9746047216807452, 0.959920717662071, 0.964099444707368, 0.9619777323550998, 0.0201426289482288, 0.0359005552926321)
MARKS = ["-5012872906644757.0000 ✓", "0.4185 ✓", "0.5310 ✓", "-0.0357 ✗", "0.3617 ✓", "-0.6456 ✓", "0.0357 ✗"]


@pytest.fixture
def log(spark):
    schema = "round int, " + ", ".join(f"{c} double" for c in ROUND_COLUMNS[1:])
    return spark.createDataFrame([LAST, FIRST], schema)


def test_summary(log):
    rows = summary(log).collect()
    assert [r["Change"] for r in rows] == MARKS
    assert [r["Initial Value"] for r in rows] == list(FIRST[1:]) and [r["Final Value"] for r in rows] == list(LAST[1:])


def test_no_change_is_not_good(spark, log):
    same = log.limit(1).union(log.limit(1).withColumn("round", log["round"] + 1))
    assert all(r["Change"].endswith("✗") for r in summary(same).collect())


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_round_trip(spark, log, tmp_path, fmt):
    write_round_log(log, str(tmp_path))
    assert [tuple(r) for r in read_round_log(spark, f"{tmp_path}/{fmt}", fmt).collect()] == [FIRST, LAST]


def test_older_logs(spark, tmp_path):
    csv, keyed = tmp_path / "results.csv", tmp_path / "results.json"
    csv.write_text("\n".join(["round," + ",".join(ROUND_COLUMNS), *[",".join(map(str, (r[0], *r))) for r in (FIRST, LAST)]]))
    keyed.write_text(json.dumps({str(r[0]): dict(zip(ROUND_COLUMNS, r)) for r in (LAST, FIRST)}, indent=4))
    for path, fmt in ((csv, "csv"), (keyed, "json")):
        assert [tuple(r) for r in read_round_log(spark, str(path), fmt).collect()] == [FIRST, LAST]


def test_text_that_is_no_number_becomes_null(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(",".join(ROUND_COLUMNS) + "\n1,oops,0.5,0.5,0.5,0.5,0.5,0.5\n")
    row = read_round_log(spark, str(path)).first()
    assert row["loss"] is None and row["accuracy"] == 0.5


def test_report_writes_the_summary(spark, log, tmp_path):
    write_round_log(log, str(tmp_path))
    tables = report(spark, f"{tmp_path}/csv", str(tmp_path))
    assert set(tables) == {"summary", "learning_curves", "precision_recall", "error_rates", "overview"}
    back = spark.read.option("header", True).csv(f"{tmp_path}/summary")
    assert back.columns == ["Metric", "Initial Value", "Final Value", "Improvement", "Change"] and back.count() == 7


def test_series_are_ordered(log):
    rows = series(log, ["loss", "accuracy"]).collect()
    assert [(r["metric"], r["round"]) for r in rows] == [("accuracy", 1), ("accuracy", 10), ("loss", 1), ("loss", 10)]


def test_flags(spark):
    losses = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 0.495), (4, 0.9)], "round int, loss double")
    rows = convergence_flags(losses, 0.01, by=()).orderBy("round").collect()
    assert [(r["plateau"], r["loss_increase"]) for r in rows] == [(False, False), (False, False), (True, False), (False, True)]
