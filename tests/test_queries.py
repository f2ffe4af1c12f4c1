"""Every registered query against its SQL on the test tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

from corpusloom.plans import QUERIES as PLANS  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(PLANS))
def test_query_matches_sql(spark, sf, con, name):
    assert name in ORACLES
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
