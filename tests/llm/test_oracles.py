"""Queries of the subpackage that SQL can express, over the smallest tables."""

import os

import pytest

from strandline.llm import queries
from tests.test_oracles import SF, compare
from tests.test_oracles import con as con  # a fixture

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])
