"""Every transit query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tests.conftest import DATA, rows_of
from tripweave.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_agrees_with_itself(spark, name):
    first = QUERIES[name](spark, str(DATA)).toPandas()
    again = QUERIES[name](spark, str(DATA)).toPandas()
    assert rows_of(first) == rows_of(again)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
