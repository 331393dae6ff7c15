"""From a stored round log to the summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardwise.operators.report import CHARTS, series, summary
from shardwise.sources.rounds import read_round_log, write_summary


def report(spark: SparkSession, log_path: str, out_dir: str | None = None, fmt: str = "csv") -> dict[str, DataFrame]:
    """Summary and chart series of a round log; the summary is also written if a folder is given."""
    log = read_round_log(spark, log_path, fmt)
    tables = {name: series(log, metrics) for name, metrics in CHARTS.items()}
    tables["summary"] = summary(log)
    if out_dir:
        write_summary(tables["summary"], f"{out_dir}/summary")
    return tables
