"""Every registered query against its SQL, or for rows where SQL cannot express it."""

import pytest

from docengine.registry import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, ORACLES[name], sf)
    else:
        assert len(df.columns) == len(set(df.columns))
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
