"""Every registered query gives the rows of its SQL."""

from __future__ import annotations

import pytest

from quern.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, data, rows_of, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).fetch_df()
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert all(f.__doc__ for f in entry.queries().values())
    assert entry.entry(spark).columns
