"""Every query with SQL gives exactly the rows DuckDB gives."""

import pytest
from oracle_compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(queries()[name](spark, sf_dir), con, oracle_sql()[name]) == []


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark, sf_dir):
    assert entry(spark).count() == 4
