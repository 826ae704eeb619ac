"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from oracle import normal, oracle_rows

QUERIES = {name: query for name, query in entry.queries().items() if name in entry.QUERIES}
SQL = {name: text for name, text in entry.oracle_sql().items() if name in entry.QUERIES}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names, _, want = oracle_rows(DATA, SQL[name])
    assert sorted(df.columns) == sorted(names)
    got = [tuple(row) for row in df.collect()]
    assert normal(df.columns, got) == normal(names, want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
