"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

from tracegrid import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", ["graph_stats", "peel_chains", "iforest", "attribution", "risk_blend"])
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
