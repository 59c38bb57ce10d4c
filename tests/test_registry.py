"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF

from logdistill.checks import registry as G
from logdistill.checks.compare import check, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(G.QUERIES))
def test_query(spark, con, name):
    result = check(spark, con, G.QUERIES[name], G.ORACLES.get(name), SF)
    assert result["ok"], result
