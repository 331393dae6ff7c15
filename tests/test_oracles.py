"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from compare import database, difference

from shardwise.catalog.oracles import SQL
from shardwise.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()) == ""


def test_every_check_has_a_query():
    assert not set(SQL) - set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
