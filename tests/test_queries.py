"""Every query against its SQL, and the entry points."""

import pytest
from oracle import same

import __spark_entry__ as entry
from shelfmark.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        same(df, queries.ORACLE_SQL[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
