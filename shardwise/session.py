"""A session for local use; on a cluster pass your own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "shardwise", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    memory = os.environ.get("SHARDWISE_DRIVER_MEMORY", "8g")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        # Call sites of column expressions are not recorded: plan building makes far fewer JVM calls.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
