"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from check_oracles import compare, connect

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert "final_decision" in df.columns


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
