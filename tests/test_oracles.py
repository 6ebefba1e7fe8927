"""Every query that SQL can express, against DuckDB on the same tables."""

import pytest
from oracle import compare

from sieveline.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, sf, name):
    compare(spark, core.QUERIES[name], core.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, sf, name):
    df = core.QUERIES[name](spark, sf)
    assert df.count() > 0 and df.columns
