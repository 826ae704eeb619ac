"""Queries that SQL can express, against their SQL on the smallest tables."""

import pytest

from conftest import DATA
from oracle import normal, oracle_rows
from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names, _, want = oracle_rows(DATA, ORACLES[name])
    got = [tuple(row) for row in df.select(*names).collect()]
    assert normal(names, got) == normal(names, want)
