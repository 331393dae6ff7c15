from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shardwise.session import local_session

    session = local_session("shardwise-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def skewed(spark):
    """900 keyed rows; client 0 holds a third of them, the other twenty share the rest."""
    from pyspark.sql import functions as F

    rows = spark.range(900).select(F.col("id").alias("key"))
    client = F.when(F.col("key") % 3 == 0, 0).otherwise(1 + F.col("key") % 20).cast("int")
    return rows.select("key", client.alias("client_id"), (F.col("key") % 7 < 2).cast("int").alias("label")).persist()
