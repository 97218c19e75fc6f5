"""Training-data queries that SQL can express, against DuckDB."""

import os

import pytest

from scripts.oracle_check import compare, duck
from stormrail.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    ok, msg = compare(QUERIES[name](spark, SF).toPandas(), duck(SF).sql(ORACLE[name]).df())
    assert ok, msg
